"""Passages repeated across documents, by sparse suffix arrays.

Of all suffixes (at word starts) only those at minimiser places are retained: the least
8-gram hash of every span of SPAN places.  Any passage of `least` (50) words holds such a place
at the same offset wherever it occurs, with `PREFIX` words after it.  Retained
suffixes are sorted, and neighbours in the order are compared: a suffix stays if one in its run of equal prefixes is another
document's.  (The order is that of hashes: first of the prefix as a whole, then of the context, then id and
place; any order that puts suffixes of one beginning side by side finds the same neighbours.)  Matches are then extended left and right:
each place answers for the windows of `least` words that chose it, and (a) places whose whole context agrees
between documents are repeats outright, (b) of the others, one representative a context is extended
window by window.  The result is exact: a word is repeated if some window of `least` words around it occurs
in another document.

Scale: the sort is by range over all of the order's columns, so a hot prefix is spread over as many partitions as its rows
need; a task holds one batch and the open run of one document.  Runs cut by a partition's ends stay (what is not repeated among
them falls out later).  Contexts and windows are only counted by key (map-side combined, hot keys are one row
each), never gathered; a text is hashed a second time only if it has a context of kind (b).
Retained suffixes are joined with their contexts by common.join_dealt: rows of a hot key are not shuffled.

Defined results: words are separated by ASCII white space, A-Z folded; documents of fewer than `least` words and
null texts repeat nothing; repeats within one document (or within rows of equal id) do not count; null ids take no part.
Only documents with repeats are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import join_dealt, row_count, stored

LEAST, GRAM, SPAN = 50, 8, 32
PREFIX = LEAST - SPAN + 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of any runs of a word sequence."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(self.n, BASE, np.uint64)])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(self.n, INVERSE, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(h * powers[:-1])]

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.back[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def anchors(roll: Rolling) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, prefix hash, context hash) of the retained suffixes."""
    n = roll.n
    if n < LEAST:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at = np.arange(n - GRAM + 1)
    grams = roll.run(at, at + GRAM)
    windows = n - LEAST + 1
    place = np.empty(windows, np.int64)
    for lo in range(0, windows, 1 << 16):
        hi = min(windows, lo + (1 << 16))
        place[lo:hi] = np.lib.stride_tricks.sliding_window_view(grams[lo : hi + SPAN - 1], SPAN).argmin(axis=1) + np.arange(lo, hi)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], windows] - 1
    p = place[first]
    context = roll.run(first, last + LEAST) ^ ((p - first).astype(np.uint64) * np.uint64(BASE)) ^ (last - first).astype(np.uint64)
    return p, first, last, roll.run(p, p + PREFIX).view(np.int64), context.view(np.int64)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes (doc, ..., hp at place 4, ...) in order of hp, those whose run of equal hp has several documents or an end of the partition."""
    held: list[pa.RecordBatch] = []  # the open run, as long as it is one document's
    open_hp = None  # prefix of an open run that stays

    for b in batches:
        if not len(b):
            continue
        first = not held and open_hp is None
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        hp, doc = t.column(4).to_numpy(), t.column(0).combine_chunks()
        other = np.asarray(pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False), bool)
        fresh = np.r_[True, hp[1:] != hp[:-1]]
        starts = np.flatnonzero(fresh)
        stays = np.maximum.reduceat(np.r_[False, other & ~fresh[1:]], starts)
        stays[0] |= first or (open_hp is not None and hp[0] == open_hp)
        many = np.diff(np.r_[starts, len(hp)])
        out = np.repeat(stays, many)
        open_hp, held = (hp[-1], []) if stays[-1] else (None, t.slice(starts[-1]).to_batches())
        yield from t.filter(pa.array(out)).to_batches()
    yield from held


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_repeated, first_doc, spans): spans are merged word ranges, array<struct<start,end>>;
    first_doc is the least id among the documents that share a passage (itself included)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in range(0, len(b), 256):
                ids, cols = [], [[] for _ in range(6)]
                for i, t in zip(b.column(0).slice(d, 256), b.column(1).slice(d, 256)):
                    roll = Rolling(word_hashes(t.as_py()))
                    got = anchors(roll)
                    ids += [i.as_py()] * len(got[0])
                    for c, v in zip(cols, (*got, np.full(len(got[0]), roll.n))):
                        c.append(v)
                flat = [pa.array(np.concatenate(c).astype(np.int64)) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *flat], names=["doc", "p", "first", "last", "hp", "hc", "n"])

    kept = stored(rows.mapInArrow(retain, f"doc {kind}, p bigint, first bigint, last bigint, hp bigint, hc bigint, n bigint"))
    order = ["hp", "hc", "doc", "p"]
    kept = stored(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(alike, kept.schema))
    classes = stored(kept.groupBy("hp", "hc").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "p", "first", "last")).alias("rep"), F.count("*").alias("many")))
    # (b): contexts of a prefix that has several; each is extended once, by its representative
    several = stored(classes.groupBy("hp").agg(F.count("*").alias("many")).where("many > 1"))
    odd = join_dealt(classes.drop("many"), several, ["hp"], "left_semi", "many", row_count(classes)).select("hp", "hc", "lo", "hi", "rep.*")
    wanted = odd.groupBy("doc").agg(F.collect_list(F.struct("hp", "hc", "lo", "hi", "p", "first", "last")).alias("ask"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, ask in zip(b.column(0), b.column(1)):
                roll = Rolling(word_hashes(t.as_py()))
                ask = pa.RecordBatch.from_struct_array(ask.values)
                p, first, last = (ask.column(k).to_numpy() for k in ("p", "first", "last"))
                ok = last + LEAST <= roll.n  # rows of equal id with different texts
                p, first, last, ask = p[ok], first[ok], last[ok], ask.filter(pa.array(ok))
                many = last - first + 1
                start = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                w = roll.run(start, start + LEAST).view(np.int64)
                take = pa.array(np.repeat(np.arange(len(p)), many))
                yield pa.RecordBatch.from_arrays([*(ask.column(k).take(take) for k in ("hp", "hc", "lo", "hi")), pa.array(start - np.repeat(p, many)), pa.array(w)], names=["hp", "hc", "lo", "hi", "off", "w"])

    windows = stored(rows.join(wanted, "doc").select("text", "ask").mapInArrow(widen, f"hp bigint, hc bigint, lo {kind}, hi {kind}, off bigint, w bigint"))
    again = windows.groupBy("w").agg(F.min("lo").alias("wlo"), F.max("hi").alias("whi")).where("wlo <> whi")
    partly = windows.where("lo = hi").join(again, "w").groupBy("hp", "hc").agg(F.collect_set("off").alias("offs"), F.min("wlo").alias("least"))
    partly = partly.join(classes.select("hp", "hc", "many"), ["hp", "hc"])
    whole = classes.where("lo <> hi").select("hp", "hc", F.col("lo").alias("least"), F.lit(None).cast("array<bigint>").alias("offs"), "many")
    marks = join_dealt(kept, stored(whole.unionByName(partly)), ["hp", "hc"], "inner", "many", row_count(kept))
    span = F.when(F.col("offs").isNull(), F.array(F.struct(F.col("first").alias("start"), (F.col("last") + LEAST).alias("end")))).otherwise(
        F.transform("offs", lambda o: F.struct((F.col("p") + o).alias("start"), (F.col("p") + o + LEAST).alias("end")))
    )
    per = marks.select("doc", "n", "least", F.explode_outer(span).alias("s")).groupBy("doc").agg(F.max("n").alias("n_words"), F.min("least").alias("first_doc"), F.array_sort(F.collect_set("s")).alias("marks"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, total = [], []
            for m in b.column(3):
                m = pa.RecordBatch.from_struct_array(m.values)
                start, end = m.column("start").to_numpy(), m.column("end").to_numpy()
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                lo, hi = start[new], reach[np.r_[new[1:], len(start)] - 1]
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
                total.append(int((hi - lo).sum()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), b.column(2), pa.array(spans, kind)], names=["doc", "n_words", "n_repeated", "first_doc", "spans"])

    out = per.mapInArrow(merge, f"doc {kind}, n_words bigint, n_repeated bigint, first_doc {kind}, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumnRenamed("doc", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    out = repeated(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_words", "n_repeated", "first_doc", spans.alias("spans"))
