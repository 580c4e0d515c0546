"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

STATS are computed in one pass over every whole text and cut to a table of a few dozen
numbers a document.  The fit takes at most about `sample_rows` labelled rows (drawn by hash):
standardised statistics are mapped by `features` random cosines (a Gaussian kernel of
width sqrt(len(STATS))), each partition sums its normal equations, and the driver adds the sums and
solves.  A quarter of those rows is left out of the ridge fit and calibrates its values by
pooled adjacent violators.

Defined results: null text counts as empty and is scored like any other; a document with several labels
counts once a label; null labels take no part; without labels of both classes every score is the mean label (0.5 if none).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import fold, is_fold, row_count
from lattix.session import cut

STATS = (
    "log_chars", "log_words", "word_len", "word_len_sd", "type_ratio", "top_word", "top3_words", "upper", "digit", "space",
    "newline", "stop", "comma", "symbol", "pipe", "bang", "non_ascii", "line_repeat", "word_symbol", "log_line_words", "entropy", "same_next",
)
_CLASS = np.zeros(256, np.int64)
for _name, _chars in enumerate((b"", bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".?", b",;:", b"#$%&*@^~_=<>\\{}[]+", b"|", b"!", bytes(range(128, 256)))):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _name


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATS))
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    kinds = np.bincount(_CLASS, weights=hist, minlength=11) / n
    words = raw.split()
    k = len(words)
    out[0], out[1] = np.log1p(n), np.log1p(k)
    if k:
        lens = np.fromiter(map(len, words), np.int64, k)
        counts = Counter(words)
        top = [c for _, c in counts.most_common(3)]
        out[2:7] = lens.mean(), lens.std(), len(counts) / k, top[0] / k, sum(top) / k
        alnum = sum(c for w, c in counts.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:?"))
        out[18] = alnum / k
        out[21] = sum(map(bytes.__eq__, words, words[1:])) / k
    out[7:17] = kinds[1:]
    lines = raw.split(b"\n")
    out[17] = 1 - len(set(lines)) / len(lines)
    out[19] = np.log1p(k / len(lines))
    p = hist[hist > 0] / n
    out[20] = -(p * np.log2(p)).sum()
    return out


def stat_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats binary): float64 values in the order of STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "stats"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, stats binary")


def _summed(rows: DataFrame, sums) -> np.ndarray | None:
    """sums(stats, y) gives an array; added up within each partition, then over the few partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(v.as_py() for v in b.column(0)), np.float64).reshape(len(b), -1)
                got = sums(x, b.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    got = [np.frombuffer(bytes(r[0]), np.float64) for r in rows.select("stats", "y").mapInArrow(run, "s binary").collect()]
    return sum(got) if got else None


def pool(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooled adjacent violators: knots (score, value), increasing."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of score * weight
    for s, v, w in zip(score[order], y[order], weight[order]):
        blocks.append([v, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, s2 = blocks.pop()
            v1, w1, s1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, s1 + s2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    def __init__(self, mean, sd, omega, phase, beta, knots, values):
        self.mean, self.sd, self.omega, self.phase, self.beta, self.knots, self.values = mean, sd, omega, phase, beta, knots, values

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.c_[np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def train(rows: DataFrame, features: int = 256, ridge: float = 1e-3, seed: int = 7, sample_rows: int = 200_000, partitions: int = 16) -> Model | float:
    """rows: (doc_id, stats, y).  A plain number, the score of every text, where only one class or none is there."""
    n = row_count(rows)
    drawn = rows if n <= sample_rows else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(n)) < sample_rows)
    rows = drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))).coalesce(partitions)
    first = _summed(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if first is None:
        return 0.5
    n, ones, d = first[0], first[1], len(STATS)
    if ones in (0, n):
        return float(ones / n)
    mean = first[2 : 2 + d] / n
    sd = np.sqrt(np.maximum(first[2 + d :] / n - mean**2, 0))
    sd[sd < 1e-9] = 1
    rng = np.random.default_rng(seed)
    model = Model(mean, sd, rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def normal(x, y):
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    fitted = rows.where("part > 0")
    sums = _summed(fitted, normal)
    if sums is None:
        return float(ones / n)
    m = features + 1
    reg = ridge * n * np.eye(m) / m
    reg[-1, -1] = 0
    beta = np.linalg.solve(sums[: m * m].reshape(m, m) + reg, sums[m * m :])
    model.beta = beta
    edges = np.linspace(-0.5, 1.5, 4097)

    def binned(x, y):
        at = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, 4095)
        return np.concatenate([np.bincount(at, minlength=4096), np.bincount(at, weights=y, minlength=4096)])

    held = _summed(rows.where("part = 0"), binned)
    if held is None:
        held = _summed(rows, binned)
    count, hits = held[:4096], held[4096:]
    full = np.flatnonzero(count)
    model.knots, model.values = pool((edges[full] + edges[full + 1]) / 2, hits[full] / count[full], count[full])
    return model


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) for each row of a stat_table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(v.as_py() for v in b.column(1)), np.float64).reshape(len(b), len(STATS))
            s = np.full(len(b), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; returns (doc_id, held_out, score, predicted) for all."""
    stats = cut(stat_table(docs, doc_id, text))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull())
    rows = stats.where(fold("doc_id", 5) != 0).join(known, "doc_id")
    out = score(stats, train(cut(rows)))
    return out.select(F.col("doc_id").alias(doc_id), is_fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
