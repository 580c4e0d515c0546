"""Benchmark decontamination by winnowing, DataFrame/SQL functions only.

Both sides are cut into words.  Every run of WINDOW consecutive words yields
WINDOW-K+1 K-gram hashes and keeps the least one (with its position); any
shared run of WINDOW words therefore shares a kept hash at the same place.
Fingerprints are joined by hash and each hit is extended to the windows that
can contain it, which are compared word for word, so the result is exact: the
hash only proposes.  Benchmark items shorter than a window are looked up by
their whole word sequence; documents emit all runs of just those lengths.

Scale: a document is first dealt into blocks of BLOCK words (with overlap), so
one giant text is many small rows, and only texts with a proposed place are read
a second time.  A side is broadcast only if its counted rows are at most
`broadcast_rows`; otherwise the join shuffles.
Equal windows of many items are one row with an item list, so a passage shared
by many items and many documents does not multiply.

Defined results: null text has no words; rows with an equal doc_id are one
document whose hits are united per text position; null item ids count as hits
but list no item; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import ascii_lower, row_count

WINDOW, K, BLOCK = 10, 6, 4096
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LONGS = "array<bigint>"
PLACE = (1 << 28) - 1


def _split(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, w): the words, case kept.  The split may leave an empty piece at either end; no window matches those."""
    df = df.select(F.col(key).alias("key"), F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS).alias("w"))
    ends = F.when(F.col("w")[0] == "", 1).otherwise(0) + F.when(F.element_at("w", -1) == "", 1).otherwise(0)
    return df.select("key", F.greatest(F.size("w") - ends, F.lit(0)).cast("long").alias("n"), "w")


def _blocks(df: DataFrame) -> DataFrame:
    """(key, n, s0, w): blocks of words with WINDOW-1 words of overlap, s0 the place of the first.

    explode_outer here and below: for explode, the optimizer infers a filter on the array that computes it twice.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK))
    pieces = F.transform(starts, lambda s: F.struct(s.cast("long").alias("s0"), F.slice("w", s + 1, BLOCK + WINDOW - 1).alias("w")))
    return df.select("key", "n", F.explode_outer(pieces).alias("b")).select("key", "n", "b.s0", "b.w")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, by + 1, F.size(name))


def _pack(h: Column, i: Column) -> Column:
    """The upper 36 hash bits over the 28-bit place, so that a plain minimum carries its place along."""
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))


def _fingerprints(blocks: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds fp: what winnowing keeps of each block, and all runs of the given short lengths.

    K-gram hashes and window minima are built by doubling (pairs, fours, ...) with zip_with, one
    pass each, in place of WINDOW element reads a word.  Case is folded in full here: that only
    proposes more; the comparison of windows folds A-Z alone.
    """
    pair, low = (lambda a, b: F.xxhash64(a, b)), (lambda a, b: F.least(a, b))
    grams = F.greatest(F.size("w") - (K - 1), F.lit(0))
    kept = F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))
    b = blocks.withColumn("wh", F.transform("w", lambda x: F.xxhash64(F.lower(x))))
    b = b.withColumn("h2", F.zip_with("wh", _shifted("wh", 1), pair))
    b = b.withColumn("h4", F.zip_with("h2", _shifted("h2", 2), pair))
    b = b.withColumn("g", F.transform(F.slice(F.zip_with("h4", _shifted("h2", 4), pair), F.lit(1), grams), _pack))
    b = b.withColumn("m2", F.zip_with("g", _shifted("g", 1), low))
    b = b.withColumn("m4", F.zip_with("m2", _shifted("m2", 2), low))
    least = F.slice(F.zip_with("m4", _shifted("g", 4), low), F.lit(1), kept)

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: _pack(F.xxhash64(F.lit(n), *[F.element_at("wh", i + j) for j in range(n)]), i - 1))
        return F.when(F.size("w") >= n, every).otherwise(F.array().cast(LONGS))

    short = [runs(n) for n in lengths]
    return b.withColumn("fp", F.concat(F.array_distinct(least), *short))


def _window_at(words: str, i: Column, n: int | Column) -> Column:
    return ascii_lower(F.array_join(F.slice(words, i, n), " "))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Per document: words, words inside a shared window, items with occurring windows, and the spans.

    Returns doc_id, n_words, n_hit, n_items, items array<string>, spans array<struct<start,end>>
    (word positions, end exclusive, merged).
    """
    from lattix.session import cut

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if row_count(df) <= broadcast_rows else df

    items = _split(benchmark, item_id, item_text).where("n > 0")
    items = items.withColumn("w", F.filter("w", lambda x: x != ""))
    sizes = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most WINDOW-1 values
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    wins = cut(
        items.select("key", F.explode(F.transform(starts, lambda i: _window_at("w", i, WINDOW))).alias("win"))
        .groupBy("win").agg(F.array_sort(F.collect_set(F.col("key").cast("string"))).alias("items"))
    )
    long_fp = _fingerprints(_blocks(items.where(F.col("n") >= WINDOW)), []).select(F.explode("fp").alias("v"))
    for k in sizes:
        long_fp = long_fp.unionByName(_fingerprints(_blocks(items.where(F.col("n") == k)), [k]).select(F.explode("fp").alias("v")))
    prints = cut(long_fp.select(F.col("v").bitwiseAND(F.lit(~PLACE)).alias("h")).distinct())

    base = _split(docs, doc_id, text)
    marker = F.when(F.col("s0") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast(LONGS))
    fps = _fingerprints(_blocks(base), sizes).select("key", "n", "s0", F.explode_outer(F.concat(marker, "fp")).alias("v"))
    fps = fps.withColumn("h", F.when(F.col("v") == -1, F.xxhash64("key")).otherwise(F.col("v").bitwiseAND(F.lit(~PLACE))))
    near = fps.join(side(prints).withColumn("hit", F.lit(True)), "h", "left").where((F.col("v") == -1) | F.col("hit"))
    place = F.when(F.col("v") != -1, F.col("s0") + F.col("v").bitwiseAND(F.lit(PLACE)) + 1).cast("int")
    found = cut(near.groupBy("key").agg(F.max("n").alias("n"), F.collect_set(place).alias("places")))

    first = F.lit(K - WINDOW)
    around = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.lit(1), p + first), p))))

    def starting(places: Column | str, k: int) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(k).alias("k")))

    at = F.concat(starting(around, WINDOW), *[starting("places", k) for k in sizes])
    some = side(found.where(F.size("places") > 0).select(F.col("key").alias("key2"), "places"))
    spots = base.join(some, F.col("key").eqNullSafe(F.col("key2"))).select("key", "w", F.when(F.col("w")[0] == "", 1).otherwise(0).alias("lead"), at.alias("at"))
    spots = spots.select("key", "lead", F.explode_outer(F.transform(F.filter("at", lambda x: x["i"] + x["k"] - 1 <= F.size("w")), lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), _window_at("w", x["i"], x["k"]).alias("win")))).alias("x")).select("key", "lead", "x.*")
    from_ = F.col("i") - 1 - F.col("lead")
    span = F.struct(from_.cast("long").alias("start"), (from_ + F.col("k")).cast("long").alias("end"))
    hits = spots.join(side(wins), "win").groupBy("key").agg(F.collect_set(span).alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    spans_t = "array<struct<start:bigint,end:bigint>>"
    merged = F.aggregate(
        F.array_sort("marks"), F.array().cast(spans_t),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    hits = hits.select(F.col("key").alias("key2"), "items", merged.alias("spans"))
    out = found.join(hits, F.col("key").eqNullSafe(F.col("key2")), "left")
    spans = F.coalesce("spans", F.array().cast(spans_t))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("key").alias(doc_id), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), spans.alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bn AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0
), bwin AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)
), lens AS (SELECT DISTINCT n FROM bwin
), dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT doc_id, i, d.n, item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.win = b.win
), wordhit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), itemhit AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id
)
SELECT d.doc_id, d.n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM (SELECT doc_id, CAST(max(len(w)) AS BIGINT) AS n_words FROM dw GROUP BY doc_id) d
LEFT JOIN wordhit ON d.doc_id IS NOT DISTINCT FROM wordhit.doc_id LEFT JOIN itemhit ON d.doc_id IS NOT DISTINCT FROM itemhit.doc_id
"""
