"""Nearest neighbours by inner product: one navigable small-world graph a shard, results merged.

Inner product becomes distance by one added coordinate, sqrt(M^2 - |x|^2), with M the largest norm.  Distinct vectors are dealt
to cells of about `shard_rows` by the nearest of a set of centroids (k-means over a sample of at most SAMPLE rows, MOST_CELLS
centroids at most); a cell of over one and a half times that size is split by hash, so that a shard's size is bounded however
the vectors clump.  Every row is in a shard.  A query meets the shards of its `probes` nearest cells, the fewest that hold
a COVER share of the true neighbours of CALIBRATION rows of the sample among the sample.  So clumped vectors
meet a few cells at any size; vectors without any structure (uniform on the sphere) need most cells, and no routing helps them.

A shard's graph is built by insertion: levels are prefixes of one random order that thin out geometrically; a level begins
with the graph of the level above, and its further nodes come in batches: each walks down from the top to its candidates (its
batch's own nearest beside them), is linked to a diverse choice of them, and linked back.  It is stored as flat arrays:
vectors in that order, and for every level a neighbour table of fixed width.

Graphs hold distinct vectors; a vector's least k + 1 ids (all a query can need, its own left
out) stand beside it and are put in before the k best are taken, so a group of copies takes one place of a walk.

A block of queries walks a graph together, WIDE expansions of all its queries a step.  The `ef` best of a walk are rescored in
double precision on the original vectors; the k best of all shards stay.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose length is
not the commonest one (the longer, on ties), take no part; ties go to the smaller id; rows with an equal id are
separate candidates, but never of their own id (components 0.0 and -0.0 are equal); a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import row_count
from lattix.session import cut

WIDTH, THIN, WIDE = 32, 16, 4
SAMPLE, MOST_CELLS = 1 << 16, 2048
COVER, CALIBRATION = 0.98, 256


def _choose(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Diverse neighbours of nodes from candidates sorted by distance (-1: none): one is kept if it is nearer to the node
    than to all kept before; free places go to the nearest left out.  -1 where there is none."""
    n, c = cand.shape
    valid = cand >= 0
    kept = np.zeros((n, c), bool)
    vec = x[np.maximum(cand, 0)]
    between = 2 - 2 * (vec @ vec.transpose(0, 2, 1))  # unit vectors
    near = between < dist[:, :, None]  # near[i, j, m]: candidate j is nearer to m than to the node
    for j in range(c):
        kept[:, j] = valid[:, j] & ~(kept & near[:, j]).any(axis=1) & (kept.sum(axis=1) < width)
    order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
    return np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cand, order, 1), -1)


def _by_similarity(nodes: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(nodes, by, 1), np.take_along_axis(sims, by, 1)


def _link_back(x: np.ndarray, table: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
    """Adds src to the neighbours of dst; where a row would overflow, a diverse choice of the WIDTH stays."""
    width = table.shape[1]
    sim = np.einsum("ij,ij->i", x[src], x[dst])
    by = np.lexsort((-sim, dst))
    src, dst = src[by], dst[by]
    node, first, many = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(first, many)
    fresh = np.full((len(node), min(width, int(many.max()))), -1, table.dtype)
    ok = place < fresh.shape[1]
    fresh[np.repeat(np.arange(len(node)), many)[ok], place[ok]] = src[ok]
    held = (table[node] >= 0).sum(axis=1)
    fits = held + many <= width
    at, col = np.nonzero(fresh[fits] >= 0)
    table[node[fits][at], held[fits][at] + col] = fresh[fits][at, col]
    full = node[~fits]
    for lo in range(0, len(full), 1024):
        own = full[lo : lo + 1024]
        cand = np.concatenate([table[own], fresh[~fits][lo : lo + 1024]], 1)
        s = np.where(cand >= 0, np.einsum("nk,nwk->nw", x[own], x[np.maximum(cand, 0)]), -np.inf)
        cand, s = _by_similarity(cand, s, cand.shape[1])
        table[own] = _choose(x, cand, np.where(cand >= 0, 2 - 2 * s, np.inf), width)


def build(x: np.ndarray, ef: int = 64, batch: int = 512) -> list[np.ndarray]:
    """Neighbour tables of the levels, top first, of the unit vectors x, whose order must be random: level l holds the nodes
    0 to len(table) - 1; -1 fills a row up."""
    sizes = [len(x)]
    while sizes[-1] > 4 * WIDTH:
        sizes.append(sizes[-1] // THIN)
    levels: list[np.ndarray] = []
    for size in sizes[::-1]:
        table = np.full((size, WIDTH), -1, np.int32)
        at = len(levels[-1]) if levels else 0
        if levels:
            table[:at] = levels[-1]
        while at < size:
            own = np.arange(at, min(size, at + batch))
            q = x[own]
            s = q @ q.T
            s[np.triu_indices(len(own))] = -np.inf  # its batch's nodes before it
            cand, s = _by_similarity(np.broadcast_to(own, s.shape), s, 16)
            if levels:
                found, fs = search(x, [*levels, table[:at]], q, min(ef, at))
                cand, s = _by_similarity(np.concatenate([found, cand], 1), np.concatenate([fs, s], 1), ef)
            cand = np.where(np.isfinite(s), cand, -1)
            # links of half the width; the others are for links back
            table[own, : WIDTH // 2] = _pad(_choose(x, cand, np.where(cand >= 0, 2 - 2 * s, np.inf), WIDTH // 2), WIDTH // 2)
            r, c = np.nonzero(table[own] >= 0)
            if len(r):
                _link_back(x, table, own[r].astype(np.int32), table[own[r], c])
            at += len(own)
        levels.append(table)
    return levels


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=-1)


def walk(x: np.ndarray, table: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once on one level; returns (nodes, similarities), each queries x ef, best first."""
    n, w = start.shape
    every = np.arange(n)
    seen = np.zeros((n, len(table)), bool)
    nodes = np.full((n, ef), -1, np.int32)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)
    fresh = start >= 0
    r, c = np.nonzero(fresh)
    seen[r, start[r, c]] = True
    nodes[:, :w] = start
    sims[r, c] = np.einsum("ij,ij->i", q[r], x[start[r, c]])
    done[:, :w] = ~fresh
    while True:
        open_sims = np.where(done, -np.inf, sims)
        live = every[open_sims.max(axis=1) > -np.inf]
        if not len(live):
            break
        open_sims = open_sims[live]
        at = np.argpartition(-open_sims, WIDE - 1, axis=1)[:, :WIDE] if ef > WIDE else np.broadcast_to(np.arange(ef), (len(live), ef))
        taken = np.take_along_axis(open_sims, at, 1) > -np.inf
        done[live[:, None], at] = True
        near = np.where(taken[:, :, None], table[nodes[live[:, None], at]], -1).reshape(len(live), -1)
        r, c = np.nonzero(near >= 0)
        to = near[r, c]
        own = live[r]
        new = ~seen[own, to]
        r, own, to = r[new], own[new], to[new]
        _, first = np.unique(own.astype(np.int64) * len(table) + to, return_index=True)
        r, own, to = r[first], own[first], to[first]
        seen[own, to] = True
        if not len(r):
            continue
        many = np.bincount(r, minlength=len(live))
        col = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
        more = np.full((len(live), int(many.max())), -1, np.int32)
        s = np.full(more.shape, -np.inf, np.float32)
        more[r, col] = to
        s[r, col] = np.einsum("ij,ij->i", q[own], x[to])
        alln, alls = np.concatenate([nodes[live], more], 1), np.concatenate([sims[live], s], 1)
        alld = np.concatenate([done[live], more < 0], 1)
        top = np.argpartition(-alls, ef - 1, axis=1)[:, :ef]
        nodes[live], sims[live], done[live] = (np.take_along_axis(v, top, 1) for v in (alln, alls, alld))
    nodes, sims = _by_similarity(nodes, sims, ef)
    return np.where(sims > -np.inf, nodes, -1), sims


def search(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in x of each query's ef nearest (or fewer: -1), nearest first, and their similarities."""
    start = np.zeros((len(q), 1), np.int32)
    for table in levels[:-1]:
        start = walk(x, table, q, start, min(len(table), 8))[0][:, :4]
    return walk(x, levels[-1], q, start, max(ef, start.shape[1]))


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; an empty cell keeps its centroid."""
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, c, 1)[:, 0]
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, own, sample)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c).astype(np.float32)
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The probes cells of largest inner product, in that order, ties to the lower number."""
    out = [np.argsort(-(x[lo : lo + 4096] @ c.T), axis=1, kind="stable")[:, :probes] for lo in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.empty((0, probes), np.int64)


def needed_probes(sample: np.ndarray, c: np.ndarray, asked: np.ndarray, k: int, cover: float = COVER) -> int:
    """The fewest nearest cells that hold a cover share of the k nearest in the sample of the vectors asked."""
    s = asked @ sample.T
    top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]  # with the vector itself
    rank = np.argsort(nearest_cells(asked, c, len(c)), axis=1)
    ranks = np.sort(np.take_along_axis(rank, nearest_cells(sample, c, 1)[:, 0][top], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(cover * len(ranks))))]) + 1


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that take part, and their length (0: none)."""
    v = F.transform(F.col(embedding).cast("array<double>"), lambda e: e + F.lit(0.0))  # no -0.0
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))
    first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (rows.where(F.size("v") == first[0]), first[0]) if first else (rows, 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def knn(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 16384, block: int = 2048, ef: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k nearest found among all other rows.

    is_query is a Column over the id column named `id`.
    """
    from pyspark.sql.window import Window

    schema = "query_id bigint, vec_id bigint, score double"
    rows, dim = clean(vectors, vec_id, embedding)
    rows = cut(rows)
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    top = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))).first()[0]
    # each vector's least k + 1 ids; an id's rows beyond the k-th change nothing
    w = Window.partitionBy("v").orderBy("id")
    least = rows.groupBy("v", "id").agg(F.count("*").alias("c")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda e: F.array_repeat(e["id"], F.least(e["c"], F.lit(k)).cast("int"))))
    vectors = cut(least.groupBy("v").agg(ids.alias("ids")))
    total = row_count(vectors)

    def lifted(v: np.ndarray) -> np.ndarray:
        u = v / top
        return np.c_[u, np.sqrt(np.maximum(0, 1 - (u * u).sum(axis=1)))].astype(np.float32)

    def flat(v: np.ndarray) -> np.ndarray:
        return np.c_[v / top, np.zeros(len(v))].astype(np.float32)

    # the sample: the vectors least by a hash, a set that does not depend on partitions
    cells = min(MOST_CELLS, -(-total // shard_rows))
    if cells > 1:
        share = min(1.0, SAMPLE / total)
        drawn = vectors.where(F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("v", F.lit("sample")), "v").limit(SAMPLE)
        sample = _matrix(drawn.select("v").toArrow().column(0).combine_chunks(), dim)
        mids = centroids(lifted(sample), cells)
        probes = needed_probes(lifted(sample), mids, flat(sample[:CALIBRATION]), k)
    else:
        mids, probes = np.zeros((1, dim + 1), np.float32), 1

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = nearest_cells(lifted(_matrix(b.column(0), dim)), mids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["v", "ids", "cell"])

    placed = cut(vectors.mapInArrow(to_cell, "v array<double>, ids array<bigint>, cell int"))
    sizes = np.zeros(cells, np.int64)
    for cell, n in placed.groupBy("cell").count().collect():
        sizes[cell] = n
    parts = -(-sizes * 2 // (3 * shard_rows))  # shards of a cell; an empty one has none
    first = np.cumsum(parts) - parts
    spot = F.array(*[F.struct(F.lit(int(f)).alias("first"), F.lit(int(max(1, p))).alias("parts")) for f, p in zip(first, parts)])[F.col("cell")]
    placed = placed.withColumn("shard", (spot["first"] + F.pmod(F.xxhash64("v"), spot["parts"])).cast("int"))

    def index(key, table):
        v, ids = _matrix(table.column("v").combine_chunks(), dim), table.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        order = [order[i] for i in np.random.default_rng(1).permutation(len(order))]
        v, ids = v[order], [ids[i] for i in order]
        counts = np.array([len(i) for i in ids], np.int64)
        graph = np.concatenate([np.r_[len(t), t.ravel()].astype(np.int32) for t in build(lifted(v))])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "counts": [counts.tobytes()], "ids": [np.array([i for own in ids for i in own], np.int64).tobytes()], "vectors": [v.tobytes()], "graph": [graph.tobytes()]})

    # as many partitions as shards: sizes in bytes, by which partitions would be merged, say nothing about the work
    most = max(1, int(parts.sum()))
    graphs = placed.drop("cell").repartition(most, "shard").groupBy("shard").applyInArrow(index, "shard int, counts binary, ids binary, vectors binary, graph binary")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest_cells(flat(_matrix(b.column(1), dim)), mids, probes)
            many = parts[near].ravel()
            row = np.repeat(np.repeat(np.arange(len(near)), probes), many)
            shard = np.repeat(first[near].ravel(), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            for lo in range(0, len(row), 8192):
                pick = pa.array(row[lo : lo + 8192])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(shard[lo : lo + 8192], pa.int32())], names=["id", "v", "shard"])

    # blocks of queries of a shard: about `block` each, however many a shard is asked
    routed = rows.where(is_query).select("id", "v").mapInArrow(route, "id bigint, v array<double>, shard int")
    asks = routed.groupBy("shard").agg(F.ceil(F.count("*") / block).alias("blocks"))
    routed = routed.join(asks, "shard").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))

    def pack(key, table):
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "qids": [table.column("id").to_numpy().tobytes()], "q": [_matrix(table.column("v").combine_chunks(), dim).tobytes()]})

    asked = routed.select("shard", "block", "id", "v").groupBy("shard", "block").applyInArrow(pack, "shard int, qids binary, q binary")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, q, counts, ids, vectors, graph in zip(*(b.column(i) for i in range(6))):
                qids, counts, ids = (np.frombuffer(v.as_py(), np.int64) for v in (qids, counts, ids))
                q, v = (np.frombuffer(w.as_py(), np.float64).reshape(-1, dim) for w in (q, vectors))
                stored, levels, at = np.frombuffer(graph.as_py(), np.int32), [], 0
                while at < len(stored):
                    size = int(stored[at])
                    levels.append(stored[at + 1 : at + 1 + size * WIDTH].reshape(size, WIDTH))
                    at += 1 + size * WIDTH
                x = lifted(v)
                # a vector's ids in a row of `own` (-1: none), its least id and the least one after
                own = np.full((len(v), counts.max()), -1, np.int64)
                has = np.arange(counts.max()) < counts[:, None]
                own[has] = ids
                other = has & (own != own[:, :1])
                second, alone = own[np.arange(len(v)), other.argmax(axis=1)], ~other.any(axis=1)
                for lo in range(0, len(q), 256):
                    asker = qids[lo : lo + 256, None]
                    found = search(x, levels, flat(q[lo : lo + 256]), min(ef, len(x)))[0]
                    self_ = own[found, 0] == asker
                    ok = (found >= 0) & ~(self_ & alone[found])
                    score = np.where(ok, np.einsum("nk,nwk->nw", q[lo : lo + 256], v[np.maximum(found, 0)]), -np.inf)
                    # the k best are among the ids of the k vectors that lead by score and least id
                    by = np.lexsort((np.where(self_, second[found], own[found, 0]), -score), axis=1)[:, :k]
                    found, score, ok = (np.take_along_axis(y, by, 1) for y in (found, score, ok))
                    every = own[found].reshape(len(found), -1)
                    score = np.repeat(score, own.shape[1], axis=1)
                    ok = np.repeat(ok, own.shape[1], axis=1) & has[found].reshape(len(found), -1) & (every != asker)
                    score = np.where(ok, score, -np.inf)
                    by = np.lexsort((every, -score), axis=1)[:, :k]
                    row, col = np.nonzero(np.take_along_axis(ok, by, 1))
                    pick = by[row, col]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[lo + row]), pa.array(every[row, pick]), pa.array(score[row, pick])], names=["query_id", "vec_id", "score"])

    found = asked.repartition(most, "shard").join(graphs.repartition(most, "shard"), "shard").select("qids", "q", "counts", "ids", "vectors", "graph").mapInArrow(answer, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    return knn(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
