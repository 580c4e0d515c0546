"""Near-copies for the pipeline: SimHash links over a Gray-order index, made whole to an exact Jaccard similarity of word shingles.

Texts are words (A-Z folded); a text's set holds the XXH64 (seed 42) of its shingles of five words, or of
the whole text where it is shorter.  Two texts are linked where the sets' Jaccard similarity is at least
SHARE (4/5, compared in whole numbers); components are the closure of all links.  Rows of equal sets are one entry.

1. The SimHash operator proposes: fingerprints of the shingles within RADIUS bits, found by its Gray-order index.  Texts at
   a similarity of 0.8 differ in about 10 of 64 bits, more than any index of blocks reaches, so the rest is found exactly:
2. sets that similar share a shingle among the first n - ceil(4n/5) + 1 of each, whatever the common order of shingles, so only
   these heads meet, by shingle.  Shingles that are in many heads come last in the order, so a line common to many texts is in
   few heads.  A shingle's entries are compared with one pivot, the entry with the most shared shingles in its head.
3. What is then in several components is compared pair by pair, in blocks of at most about 2 x CHUNK entries, without
   emitting pairs: an entry carries a parity bitmap of its set, and two sets differ in at least as many hashes as their
   bitmaps differ in bits.  Only pairs that may differ in a ninth of their joint size or less, as similarity 4/5 means, leave
   the task.

Every proposed pair is confirmed on the whole sets, so links are exact and none is lost.  The comparison by blocks is of the square of a
shingle's entries in several components, at about 10^7 pairs a core second; entries alike to a pivot do not take part with each other.

Defined results: null and wordless texts have the empty set and are copies of each other; a null doc_id row
is linked like any other but never names a component (all null: component null).  `kept` keeps one row of each component: the
least doc_id (null last), of rows with that id the least hash of all columns, so a null id stays where it is alone or all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.llm import simhash
from lattix.llm.common import discard, join_dealt, lean, row_count, short_batches, stored

SHARE = (4, 5)
RADIUS = 3
CHUNK = 1024
NEEDED = 1 << 20


def hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the text's shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(shingle, len(words)) - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    return np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(hashes(text, shingle))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SHARE[1] >= SHARE[0] * (len(a) + len(b) - both)


def may_be_alike(differ, sizes):
    """Whether sets of joint size `sizes` that differ in at least `differ` hashes can be alike."""
    return (SHARE[0] + SHARE[1]) * differ <= (SHARE[1] - SHARE[0]) * sizes


def parity(h: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, as words of 64 bits: the least power of two of bits that is len(h) or more, 512 at least.
    Bit h mod 2^b flips with every hash h."""
    size = max(512, 1 << (len(h) - 1).bit_length()) if len(h) else 512
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) of half the size: bit p mod 2^b is the sum of bits p and p + 2^b, so halves are added without carry."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def head(h: np.ndarray, last: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of a set, the shingles `last` (sorted) after all others, the less often found first."""
    keep = len(h) + (-SHARE[0] * len(h) // SHARE[1]) + 1 if len(h) else 0
    if len(last):
        at = np.minimum(np.searchsorted(last, h), len(last) - 1)
        h = h[np.argsort(np.where(last[at] == h, often[at], 0), kind="stable")]
    return h[:keep].view(np.int64)


NONE = np.empty(0, np.uint64), np.empty(0, np.int64)


def _sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(doc struct of the other columns, text, sig, fp, n, bits, tokens, row): digest, fingerprint, size, bitmap and head of the set.
    Sets are made again from the text where they are needed, as they take more disk than the text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for x in b.column(1):
                h = hashes(x.as_py(), shingle)
                s = np.unique(h)
                for c, v in zip(out, (xxhash.xxh3_128_digest(s.tobytes()), simhash.majority(h), len(s), parity(s).tobytes(), head(s, *NONE))):
                    c.append(v)
            sig, fp, n, bits, tokens = out
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sig, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc", "text", "sig", "fp", "n", "bits", "tokens"],
            )

    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_"))
    rows = docs.select(doc.alias("doc"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    rows = rows.mapInArrow(lean(run), f"doc {kind}, text string, sig binary, fp bigint, n bigint, bits binary, tokens array<bigint>")
    with short_batches(docs.sparkSession):
        return stored(rows.withColumn("row", F.monotonically_increasing_id()))


def _heads(rows: DataFrame, last: np.ndarray, often: np.ndarray, shingle: int) -> DataFrame:
    """rows (sig, row, fp, n, bits, tokens, text) without the text, heads in the order where the shingles `last` come last.
    A head without any of them stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, stops = b.column(5).flatten().to_numpy().view(np.uint64), b.column(5).offsets.to_numpy()
            stops = stops - stops[0]
            hit = np.r_[0, np.cumsum(last[np.minimum(np.searchsorted(last, old), len(last) - 1)] == old)]
            heads = [head(shingles(b.column(6)[i].as_py(), shingle), last, often) if hit[y] > hit[x] else old[x:y].view(np.int64) for i, (x, y) in enumerate(zip(stops[:-1], stops[1:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(heads, pa.list_(pa.int64()))], names=["sig", "row", "fp", "n", "bits", "tokens"])

    rows = rows.select("sig", "row", "fp", "n", "bits", "tokens", "text")
    return rows.mapInArrow(lean(run), "sig binary, row bigint, fp bigint, n bigint, bits binary, tokens array<bigint>") if len(last) else rows.drop("text")


def _sift(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be alike by size and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            differ = np.zeros(len(b), np.int64)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                x, y = (np.frombuffer(v, np.uint64)[None] for v in sorted((x, y), key=len))
                differ[i] = np.bitwise_count(x ^ (y if x.size == y.size else folded(y))).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(may_be_alike(differ, n)))

    left, right = (sets.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").where(_near("na", "nb"))
    return both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(lean(run), "a bigint, b bigint")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(src, dst) of the pairs (a, b) that are alike; pairs are read more than once.  Only texts of a pair are shuffled: their rows
    are broadcast if they are counted to be NEEDED at most, and else joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(256)(lambda row, t: shingles(t, shingle))
        for b in batches:
            ok = [alike(of(p, x.as_py()), of(q, y.as_py())) for p, q, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    rows = stored(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    few = F.broadcast(rows) if row_count(rows) <= NEEDED else rows
    own = texts.select("row", "text").join(few, "row", "left_semi")
    both = pairs.join(own.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")
    with short_batches(pairs.sparkSession):
        out = stored(both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "src bigint, dst bigint"))
    discard(rows)
    return out


def _near(n: str, m: str):
    """Whether sets of n and m shingles can be alike at all."""
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def close_pairs(key: np.ndarray, chunk: np.ndarray, cross: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], piece: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of entries of one key (they are sorted by it) and of two components that may be alike by size and bitmap.
    Where cross holds, only pairs of two chunks count (the others meet in a block of their own)."""
    if not len(key):
        return
    width = np.array([len(b) // 8 for b in bits])
    place = np.zeros(len(key), np.int64)
    maps: dict[int, np.ndarray] = {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        place[own] = np.arange(len(own))
        maps[w] = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), w)
    half = {w: folded(m) for w, m in maps.items() if w > 1}
    stop = np.searchsorted(key, key, side="right")
    many = stop - np.arange(len(key)) - 1
    total = np.cumsum(many)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + piece, side="right")))
        m = many[at:to]
        i = np.repeat(np.arange(at, to), m)
        j = i + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        stay = (comp[i] != comp[j]) & (~cross[i] | (chunk[i] != chunk[j])) & (np.minimum(n[i], n[j]) * SHARE[1] >= np.maximum(n[i], n[j]) * SHARE[0])
        i, j = i[stay], j[stay]
        i, j = np.where(width[i] <= width[j], i, j), np.where(width[i] <= width[j], j, i)
        ok = np.zeros(len(i), bool)
        for w in np.unique(width[i]):
            for v, table in ((w, maps.get(w)), (2 * w, half.get(2 * w))):
                here = np.flatnonzero((width[i] == w) & (width[j] == v))
                for lo in range(0, len(here), max(1, (1 << 19) // int(w))):
                    h = here[lo : lo + max(1, (1 << 19) // int(w))]
                    differ = np.bitwise_count(maps[w][place[i[h]]] ^ table[place[j[h]]]).sum(axis=1, dtype=np.int64)
                    ok[h] = may_be_alike(differ, n[i[h]] + n[j[h]])
        yield i[ok], j[ok]
        at = to


def _blocks(entries: DataFrame) -> DataFrame:
    """(a, b) pairs that may be alike: entries are (key, cross, chunk, row, comp, n, bits), dealt and sorted by key here."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t.column(c).to_numpy() for c in ("key", "cross", "chunk", "row", "comp", "n")}
        for i, j in close_pairs(col["key"], col["chunk"], col["cross"].astype(bool), col["comp"], col["n"], t.column("bits").to_pylist()):
            a, b = col["row"][i], col["row"][j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key = held.column("key").to_numpy()
            at = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if at:
                yield from solve(held.slice(0, at))
                held = held.slice(at).combine_chunks()
        if held is not None and held.num_rows:
            yield from solve(held)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "a bigint, b bigint")


def links(rows: DataFrame, shingle: int = 5, limit: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """rows: the table of _sets.  Returns (sets, edges): (sig, row) with one row a distinct set, and edges (src, dst) between
    those rows whose closure is that of all alike pairs."""
    from lattix.operators.graph import connected_components

    total = row_count(rows)
    limit = limit or max(20, total // 10_000)

    # shingles in over `limit` heads come last: with heads of h shingles on average there are at most 10,000 h, whatever the size
    often = stored(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("many")).where(F.col("many") > limit))
    got = often.toArrow()
    last, many = got.column("token").to_numpy().view(np.uint64), got.column("many").to_numpy()
    by = np.argsort(last)
    one = F.min_by(F.struct("fp", "n", "bits", "tokens"), "row")
    with short_batches(rows.sparkSession):
        sets = stored(_heads(rows, last[by], many[by], shingle).groupBy("sig").agg(F.min("row").alias("row"), one.alias("x")).select("sig", "row", "x.*"))

    # 1: SimHash
    lead = stored(sets.groupBy("fp").agg(F.min("row").alias("lead"), F.count("*").alias("many")))
    same = join_dealt(sets.select("fp", "row"), lead, ["fp"], "inner", "many", total).where("row > lead").select(F.col("lead").alias("a"), F.col("row").alias("b"))
    other = simhash.links(lead.select("fp"), RADIUS).join(lead.select(F.col("fp").alias("src"), F.col("lead").alias("x")), "src").join(lead.select(F.col("fp").alias("dst"), F.col("lead").alias("y")), "dst")
    pairs = same.unionByName(other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    pairs = stored(_sift(pairs, sets))
    edges = _confirm(pairs, rows, shingle)
    discard(pairs, lead)

    # 2: shingles of the heads, and pivots
    flat = sets.select("row", "n", F.explode("tokens").alias("token"))
    entries = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    # what was often found is broadcast (its bound is above) and may be hot; all else is in few heads and shuffled once
    late = F.broadcast(often.select("token"))
    cold = flat.join(late, "token", "left_anti").withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1").drop("many")
    warm = flat.join(late, "token", "left_semi")
    sizes = stored(warm.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"))
    met = stored(cold.select("row", "n", "token").unionByName(join_dealt(warm, sizes, ["token"], "inner", "many", entries).select("row", "n", "token")))
    discard(sizes, often)
    shared = met.groupBy("row").agg((F.count("*") / (F.max("n") - F.ceil(F.max("n") * SHARE[0] / SHARE[1]) + 1)).alias("shared"))
    near = stored(sets.select("row", "n", "bits").join(shared, "row"))

    here = stored(met.join(near.select("row", "shared"), "row"))
    pivot = F.max_by(F.struct(F.col("row").alias("b"), F.col("n").alias("nb")), F.struct("shared", -F.col("row"))).alias("p")
    pivots = stored(here.groupBy("token").agg(F.count("*").alias("many"), pivot).select("token", "many", "p.*"))
    pairs = join_dealt(here, pivots, ["token"], "inner", "many", entries).where(F.col("row") != F.col("b")).where(_near("n", "nb"))
    tested = stored(pairs.select(F.least("row", "b").alias("a"), F.greatest("row", "b").alias("b")).distinct())
    pairs = stored(_sift(tested, near))
    edges = edges.unionByName(_confirm(pairs, rows, shingle))
    discard(pairs, pivots, here)
    comp = connected_components(edges).select(F.col("node").alias("row"), F.col("component").alias("to"))
    comp = stored(near.select("row", "bits").join(comp, "row", "left").withColumn("comp", F.coalesce("to", "row")).drop("to"))

    # 3: blocks.  An entry of chunk c meets chunk o in the block of both, and its own chunk in the block (c, c)
    open_ = met.join(comp.select("row", "comp"), "row").groupBy("token").agg(F.count("*").alias("many"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_ = stored(open_.where("lo < hi").drop("lo", "hi"))
    dealt = join_dealt(met, open_.withColumn("chunks", F.ceil(F.col("many") / chunk).cast("int")), ["token"], "inner", "many", entries)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.xxhash64("token", F.least("chunk", "o"), F.greatest("chunk", "o"))
    dealt = dealt.select(key.alias("key"), (F.col("chunk") != F.col("o")).cast("int").alias("cross"), "chunk", "row", "n").join(comp.select("row", "comp", "bits"), "row")
    found = _blocks(dealt.select("key", "cross", "chunk", "row", "comp", "n", "bits")).distinct()
    with short_batches(rows.sparkSession, 4096):
        pairs = stored(found.join(tested, ["a", "b"], "left_anti"))
    edges = edges.unionByName(_confirm(pairs, rows, shingle))
    discard(pairs, tested, met, near, comp, open_)
    return sets.select("sig", "row"), edges


def _labelled(rows: DataFrame, shingle: int, limit: int | None) -> DataFrame:
    """(sig, component): component is a row of it."""
    from lattix.operators.graph import connected_components

    sets, edges = links(rows, shingle, limit)
    comp = connected_components(edges).withColumnRenamed("node", "row")
    out = stored(sets.join(comp, "row", "left").select("sig", F.coalesce("component", "row").alias("component")))
    discard(sets, edges)
    return out


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, limit: int | None = None) -> DataFrame:
    """(doc_id, component_id) for each row: component_id is the least doc_id reachable over links, itself included."""
    rows = _sets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle)
    rows = rows.join(_labelled(rows, shingle, limit), "sig").select("doc.doc_id", "component")
    return rows.join(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, limit: int | None = None) -> DataFrame:
    """The rows of docs that stay, one of each component, with their columns."""
    rows = _sets(docs, text, shingle)
    first = F.min(F.struct(F.col(f"doc.`{doc_id}`").isNull().alias("none"), F.col(f"doc.`{doc_id}`").alias("id"), F.xxhash64("doc", "text").alias("h"), "row")).alias("first")
    stay = rows.join(_labelled(rows, shingle, limit), "sig").groupBy("component").agg(first).select("first.row")
    back = [F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return rows.join(stay, "row", "left_semi").select(*back)
