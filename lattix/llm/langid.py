"""Language identification with string kernels.

A text is the set of its blended 1..4-grams of letters (any case, runs of
non-letters count as one blank), hashed to DIM slots.  The presence kernel is
k(x, y) = |x & y| / sqrt(|x| |y|).  `landmarks` training texts give Nystrom features
K(x, L) K(L, L)^(-1/2); one ridge regression a language (one against the rest) is fitted
on them.  Since the kernel is linear in the presence vector, landmarks and
weights fold into one DIM x languages matrix, and a batch of texts is scored by one
sparse presence-matrix product with it.

The fit uses at most about `sample_rows` labelled rows, drawn by a hash of the id in equal
shares a language; each reaches the driver as a bit set of DIM/8 bytes whatever
its length.  Scoring reads every whole text.

Defined results: null text or no letter: `und`, score 0; no labelled training row: `und`, score 0 for all;
a null id is neither learned from nor held out.
score = (1 + the winning regression's value) / 2, held to 0..1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import fold, is_fold, lean, row_count

DIM, GRAMS = 1 << 15, 4
WORDS = re.compile(r"[^\W\d_]+")
MAPPED = 1 << 16


def letters(text: str) -> list[str]:
    """Runs of letters, which are what str.isalpha says (superscripts, fractions and number signs are none)."""
    found = []
    for run in WORDS.findall(text):
        found += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return found


def presence(text: str | None) -> np.ndarray:
    """Sorted slots of the n-grams that occur in the whole text; empty if it has no letter."""
    found = letters(text.lower()) if text else []
    if not found:
        return np.empty(0, np.int64)
    flags = np.zeros(DIM, bool)
    joined = " " + " ".join(found) + " "
    step = 1 << 20
    for at in range(0, len(joined), step):  # bounded memory; pieces overlap by a gram
        c = np.frombuffer(joined[at : at + step + GRAMS - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, GRAMS + 1):
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] * np.uint64(2 * n + 1)
            if not len(h):
                break
            g = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            flags[(g >> np.uint64(64 - 15)).astype(np.int64)] = True
    return np.flatnonzero(flags)


class Model:
    """langs, and the DIM x languages matrix that landmarks and ridge weights fold into."""

    def __init__(self, langs: list[str], matrix: np.ndarray, bias: np.ndarray):
        self.langs, self.matrix, self.bias = langs, matrix.astype(np.float32), bias

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values, texts x languages, by one product over the batch."""
        sizes = np.array([len(s) for s in sets])
        out = np.tile(self.bias, (len(sets), 1))
        full = np.flatnonzero(sizes)
        if len(full):
            rows = self.matrix[np.concatenate([sets[i] for i in full])]
            sums = np.add.reduceat(rows, np.r_[0, np.cumsum(sizes[full])[:-1]], axis=0)
            out[full] += sums / np.sqrt(sizes[full])[:, None]
        return out


def fit(bits: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> Model:
    """bits: rows x DIM/8 packed presence sets; langs: their labels.  Landmarks are dealt evenly over the languages."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    turn = np.empty(len(y), int)
    for c in range(len(names)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.sort(np.lexsort((y, turn))[:landmarks])
    size = np.bitwise_count(bits).sum(axis=1).astype(np.float64)
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32) / np.sqrt(size[chosen])[:, None].astype(np.float32)
    k = np.empty((len(y), len(chosen)))
    for at in range(0, len(y), 256):
        k[at : at + 256] = (np.unpackbits(bits[at : at + 256], axis=1).astype(np.float32) @ marks.T) / np.sqrt(size[at : at + 256])[:, None]
    w, v = np.linalg.eigh(k[chosen])
    root = v / np.sqrt(np.maximum(w, 1e-6)) @ v.T
    phi = np.c_[k @ root, np.ones(len(y))]
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    weight *= len(y) / weight.sum()
    reg = ridge * np.eye(phi.shape[1])
    reg[-1, -1] = 1e-9
    beta = np.linalg.solve((phi * weight[:, None]).T @ phi + reg, (phi * weight[:, None]).T @ target)
    return Model(names, marks.T @ (root @ beta[:-1]).astype(np.float32), beta[-1])


def train(labelled: DataFrame, key: str, text: str, lang: str, sample_rows: int = 2400, landmarks: int = 256) -> Model | None:
    """Fits on at most about sample_rows rows of labelled (null languages take no part)."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("l").isNotNull())
    counts = rows.groupBy("l").agg(F.count("*").alias("n"))
    langs = row_count(counts)
    if not langs:
        return None
    # however many values a dirty column has, about sample_rows are drawn
    odds = F.least(F.lit(1.0), F.lit(sample_rows / langs) / F.col("n"))
    draw = F.pmod(F.xxhash64("k", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(counts) if langs <= MAPPED else counts, "l").where(draw < odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for t in b.column(0):
                flags = np.zeros(DIM, bool)
                flags[presence(t.as_py())] = True
                bits.append(np.packbits(flags).tobytes() if flags.any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), b.column(1)], names=["bits", "l"])

    got = sorted((r for r in drawn.select("t", "l").mapInArrow(run, "bits binary, l string").where("bits is not null").collect()), key=lambda r: (r["l"], bytes(r["bits"])))
    if not got:
        return None
    return fit(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), [r["l"] for r in got], landmarks)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added; text is read whole, other columns pass through untouched."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):  # sets of few texts at a time are held
                b = batch.slice(lo, 256)
                sets = [presence(t.as_py()) for t in b.column(at)] if model else [np.empty(0, int)] * len(b)
                v = model.values(sets) if model else np.full((len(b), 1), -1.0)
                some = [len(s) > 0 for s in sets]
                pred = [model.langs[k] if ok else "und" for k, ok in zip(v.argmax(axis=1), some)]
                score = np.where(some, np.clip((1 + v.max(axis=1)) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fits on rows whose crc32(doc_id) mod 5 is not 0 and scores all; returns (doc_id, held_out, lang_pred, score)."""
    model = train(docs.where(fold(doc_id, 5) != 0), doc_id, text, lang)
    out = predict(docs.select(F.col(doc_id), F.col(text).cast("string").alias(text)), model, text)
    return out.select(doc_id, is_fold(doc_id, 5, 0).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    return identify(read_table(spark, sf_dir, "documents"))
