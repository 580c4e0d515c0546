"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: words of a text (A-Z folded), shingles of `shingle` words, XXH64
(seed 42) of each; a bit is set where over half of the hashes set it.

Links: fingerprints at `radius` (2) or fewer differing bits.  Equal fingerprints
are one entry.  Entries are dealt by radius + 1 rotations so that each of as many bit
blocks leads once: two codes within the radius agree on a whole block, so they
meet under some (rotation, block value).  A key with over `limit` entries is dealt
again by blocks of its remaining bits, and again; what is left then spans too
few bits to be large, so no group is unbounded and nothing is dropped.  Inside a key,
entries are sorted by Gray rank and grouped into a tree: a node holds the bits
its members share beyond its parent's, and a search drops a whole node once its
accumulated differences pass the radius.  Found links are reduced per batch
to one edge an entry (a spanning forest), then joined up by distributed connected
components.

Defined results: null or wordless texts have fingerprint zero; rows with equal
doc_id are separate rows of one document; a null doc_id row is linked like any
other but never names a component (all null: component null).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.session import cut

LIMIT = 4096
FANOUT = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    h64, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def majority(h: np.ndarray) -> int:
    """Fingerprint of shingle hashes, repeats included: a bit is set where over half of them set it (none: zero)."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp bigint): one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, len(b)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence (the inverse of n ^ n >> 1)."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_links(keys: np.ndarray, codes: np.ndarray, radius: int, frontier: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with equal key and codes within radius, in bounded pieces.  Rows must be sorted by (key, Gray rank).

    One forest over all keys: level 0 holds single codes, each upper node up to FANOUT consecutive nodes of one key.
    """
    n = len(codes)
    levels = []  # (first child, last child + 1, shared mask, value)
    key, lo, hi, mask, val, last = keys, np.arange(n), np.arange(n) + 1, np.full(n, ~np.uint64(0)), codes, np.arange(n)
    levels.append((lo, hi, mask, val, last))
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        first = np.flatnonzero(place % FANOUT == 0)
        if len(first) == len(key):
            break
        ones = np.bitwise_and.reduceat(np.where(mask == ~np.uint64(0), val, val & mask), first)
        every = np.bitwise_and.reduceat(mask, first)
        some = np.bitwise_or.reduceat(val & mask, first)
        m = every & ~(ones ^ some)
        stop = np.r_[first[1:], len(key)]
        last = last[stop - 1]
        key, mask, val = key[first], m, ones & m
        levels.append((first, stop, mask, val, last))
    top = len(levels) - 1
    root_of = np.searchsorted(key, keys)
    widest = int(np.unique(keys, return_counts=True)[1].max()) if n else 1
    block = max(1, min(8192, frontier // widest))
    for at in range(0, n, block):
        q = np.arange(at, min(n, at + block))
        node = root_of[q]
        acc = np.bitwise_count((codes[q] ^ levels[top][3][node]) & levels[top][2][node]).astype(np.int64)
        stay = (acc <= radius) & (levels[top][4][node] > q)
        q, node, acc = q[stay], node[stay], acc[stay]
        for depth in range(top, 0, -1):
            lo, hi, mask, _, _ = levels[depth]
            many = hi[node] - lo[node]
            up = np.repeat(node, many)
            child = np.repeat(lo[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            q, acc = np.repeat(q, many), np.repeat(acc, many)
            _, _, cmask, cval, clast = levels[depth - 1]
            acc = acc + np.bitwise_count((codes[q] ^ cval[child]) & cmask[child] & ~mask[up])
            stay = (acc <= radius) & (clast[child] > q)
            q, node, acc = q[stay], child[stay], acc[stay]
        yield q, node


def forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Least index reachable from each of n nodes over the pairs, taken in piece by piece."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, up := root[root]):
                root = up
            stay = root[i] != root[j]
            i, j = i[stay], j[stay]
    return root


def _search(radius: int):
    """Rows (key, fp) arrive sorted by key, Gray rank; yields (src, dst) edges, holding back the last key until it is whole."""

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), key))
        key, fp = key[order], fp[order]
        root = forest(gray_links(key, fp, radius), len(fp))
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            at = np.searchsorted(keys, keys[-1]) if len(keys) and keys[0] <= keys[-1] else 0
            if at:
                yield solve(keys[:at], fps[:at])
                keys, fps = keys[at:], fps[at:]
        if len(keys):
            yield solve(keys, fps)

    return run


def _dealt(rows: DataFrame, bits: list[tuple[str, object, object]]) -> DataFrame:
    """Adds one row for each block: the key hashed with the block's number and value, and the block's bits removed from free."""
    pieces = [F.struct(F.xxhash64("key", F.lit(name), F.col("fp").bitwiseAND(m)).alias("key"), F.col("free").bitwiseAND(F.bitwise_not(m)).alias("free")) for name, m, _ in bits]
    return rows.select("fp", F.explode_outer(F.array(*pieces)).alias("x")).select("fp", "x.key", "x.free")


def _masks(level: int, parts: int = 3) -> list[tuple[str, object, object]]:
    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    if level == 0:
        stops = [-(-64 * i // parts) for i in range(parts + 1)]  # blocks of about equal width, from the top
        masks = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(stops, stops[1:])]
        return [(f"0.{i}", F.lit(signed(m)).cast("bigint"), None) for i, m in enumerate(masks)]
    # every parts-th (or its square's) bit: whatever block is gone, the rest splits into about equal parts
    step = parts ** (level - 1)
    masks = [sum(1 << b for b in range(64) if (b // step) % parts == r) for r in range(parts)]
    return [(f"{level}.{i}", F.lit(signed(m)).cast("bigint").bitwiseAND(F.col("free")), None) for i, m in enumerate(masks)]


def links(fps: DataFrame, radius: int = 2, limit: int = LIMIT) -> DataFrame:
    """(src, dst) edges between distinct fingerprints (column fp) whose closure is that of all links within radius.

    Codes within radius agree on a whole one of radius + 1 blocks, whatever the radius; a larger one has narrower
    blocks and so larger keys.
    """
    rows = fps.select("fp").distinct().withColumn("key", F.lit(0).cast("bigint")).withColumn("free", F.lit(-1).cast("bigint"))
    parts = []
    for level in range(3):
        rows = _dealt(rows, _masks(level, radius + 1))
        sizes = rows.groupBy("key").count()
        if level == 2:
            parts.append(rows.join(sizes.where("count > 1").select("key"), "key", "left_semi"))
            break
        parts.append(rows.join(sizes.where((F.col("count") > 1) & (F.col("count") <= limit)).select("key"), "key", "left_semi"))
        big = cut(rows.join(sizes.where(F.col("count") > limit).select("key"), "key", "left_semi"))
        if big.isEmpty():
            break
        rows = big
    edges = None
    for p in parts:
        p = p.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_search(radius), "src bigint, dst bigint")
        edges = p if edges is None else edges.unionByName(p)
    return edges


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp bigint, component_id): component_id is the least doc_id reachable over links, itself included."""
    from lattix.operators.graph import connected_components

    fps = cut(fingerprints(docs, doc_id, text, shingle))
    comp = connected_components(links(fps, radius)).withColumnRenamed("node", "fp")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = least.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = label.groupBy("component").agg(F.min("low").alias("component_id"))
    label = label.join(lows, "component").select(F.col("fp").alias("fp2"), "component_id")
    return fps.join(label, F.col("fp") == F.col("fp2"), "left").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    out = components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
