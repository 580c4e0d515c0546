"""Clustering, regionalisation and dimension reduction.

K-means and PCA work on sums over partitions; DBSCAN is a grid join and
connected components.  Hierarchical and SKATER trees are sequential: they run as one
task over at most MOST rows and raise beyond, but for contiguous linkage, which keeps
distances of adjacent clusters alone and takes every row.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import scalars

MOST = 4000


def _features(df: DataFrame, key: str, xs: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), *[F.col(x).cast("double").alias(f"f{i}") for i, x in enumerate(xs)]).dropna()


def _collect(df: DataFrame, key: str, xs: list[str], bound: int | None = MOST) -> tuple[list, np.ndarray]:
    rows = _features(df, key, xs)
    rows = sorted((rows if bound is None else rows.limit(bound + 1)).collect())
    if bound is not None and len(rows) > bound:
        raise ValueError(f"this operator takes at most {bound} rows")
    return [r[0] for r in rows], np.array([list(r[1:]) for r in rows], float).reshape(len(rows), len(xs))


def standard_matrix(df: DataFrame, key: str, xs: list[str], bound: int | None = MOST) -> tuple[list, np.ndarray]:
    """Ids and standardized values of at most `bound` rows (more raise; None: every row)."""
    ids, x = _collect(df, key, xs, bound)
    if len(ids) < 2:
        return ids, np.zeros((len(ids), len(xs)))
    sd = x.std(axis=0, ddof=1)
    return ids, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)


def _table(df: DataFrame, key: str, ids: list, labels) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(i, int(c)) for i, c in zip(ids, labels)], f"{key} {kind}, cluster int")


def relabel(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """Clusters numbered 1, 2, ... by falling size, then least key."""
    from lattix.functions.scalars import with_rank

    g = df.groupBy(F.col(cluster).alias("__c")).agg(F.count("*").alias("n"), F.min(key).alias("low"))
    place = with_rank(g, [F.desc("n"), F.asc("low")], "__r").select("__c", F.col("__r").cast("int").alias("__r"))
    return df.join(place, F.col(cluster) == F.col("__c")).withColumn(cluster, F.col("__r")).drop("__c", "__r")


def kmeans(df: DataFrame, key: str, xs: list[str], k: int, seed: int = 1, iterations: int = 300, standardize: bool = True) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = _features(df, key, xs)
    cols = [c for c in d.columns if c != "id"]
    if standardize:
        from lattix.operators.autocorr import standardized

        d = standardized(d, *cols)
    v = VectorAssembler(inputCols=cols, outputCol="v").transform(d)
    fit = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="v", predictionCol="cluster").fit(v)
    return relabel(fit.transform(v).select(F.col("id").alias(key), F.col("cluster")), key, "cluster")


def kmedians(df: DataFrame, key: str, xs: list[str], k: int, seed: int = 1, iterations: int = 50) -> DataFrame:
    """Manhattan distance, median centres; each round is a projection and one grouped median."""
    d = _features(df, key, xs)
    cols = [c for c in d.columns if c != "id"]
    centres = [[float(r[c]) for c in cols] for r in d.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()]
    for _ in range(iterations):
        dist = [sum((F.abs(F.col(c) - v) for c, v in zip(cols, m)), F.lit(0.0)) for m in centres]
        low = F.least(*dist) if len(dist) > 1 else dist[0]
        pick = F.coalesce(*[F.when(x == low, i) for i, x in enumerate(dist)])
        got = {r["cluster"]: [float(r[c]) for c in cols] for r in d.withColumn("cluster", pick).groupBy("cluster").agg(*[F.median(c).alias(c) for c in cols]).collect()}
        new = [got.get(i, m) for i, m in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return relabel(d.withColumn("cluster", pick).select(F.col("id").alias(key), "cluster"), key, "cluster")


def dbscan(points: DataFrame, key: str, radius: float, min_points: int, x: str = "x", y: str = "y", borders: bool = True) -> DataFrame:
    """(key, cluster): clusters numbered from 1 by size; -1 noise; a border point joins the core neighbour's cluster of least number.  min_points counts the point itself.

    Without borders (DBSCAN*) only core points belong to clusters, as when the mutual-reachability tree is cut at the radius.
    """
    from lattix.operators.graph import connected_components
    from lattix.operators.weights import pairs_within
    from lattix.session import cut

    near = cut(pairs_within(points, key, radius, x, y).select("src", "dst"))
    ids = points.select(F.col(key).alias("id"))
    core = ids.join(near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_points).select("id")
    core = cut(core)
    inner = near.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
    comp = connected_components(inner).select(F.col("node").alias("id"), F.col("component"))
    comp = core.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    border = near.join(core.withColumnRenamed("id", "src"), "src", "left_anti").join(comp.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("component"))
    found = relabel(comp.unionByName(border) if borders else comp, "id", "component")
    return ids.join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("component", F.lit(-1)).alias("cluster"))


class Near:
    """Symmetric neighbour lists in arrays; near[i]: the neighbours of place i, rising, without itself.

    Places of one kind are neighbours of each other and share all others; a and b are then ends of edges between kinds.  Without kinds every place is its own."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, kind: np.ndarray | None = None):
        self.kind = np.arange(n) if kind is None else np.unique(kind, return_inverse=True)[1].reshape(-1)
        self.kinds = int(self.kind.max()) + 1 if n else 0
        a, b, wide = np.asarray(a, np.int64), np.asarray(b, np.int64), max(self.kinds, 1)
        keep = a != b
        code = np.unique(np.r_[a[keep] * wide + b[keep], b[keep] * wide + a[keep]])
        self.start = np.searchsorted(code // wide, np.arange(self.kinds + 1))
        self.to = (code % wide).astype(np.int32)
        self.member = np.argsort(self.kind, kind="stable")
        self.first = np.searchsorted(self.kind[self.member], np.arange(self.kinds + 1))

    def __len__(self) -> int:
        return len(self.kind)

    def around(self, c: int) -> list[int]:
        """The other kinds next to a kind."""
        return self.to[self.start[c] : self.start[c + 1]].tolist()

    def __getitem__(self, i: int) -> list[int]:
        if self.kinds == len(self.kind):
            return self.around(i)
        c = self.kind[i]
        got = np.sort(np.concatenate([self.member[self.first[k] : self.first[k + 1]] for k in (c, *self.around(c))]))
        return got[got != i].tolist()

    def of(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all edges between kinds that leave these."""
        n = self.start[kinds + 1] - self.start[kinds]
        at = np.repeat(self.start[kinds] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(kinds, n), self.to[at].astype(np.int64)

    def parts(self) -> list[list[int]]:
        """Connected parts, by their first places."""
        seen, out = np.zeros(self.kinds, bool), []
        for c in range(self.kinds):
            if seen[c]:
                continue
            seen[c], todo = True, [c]
            for k in todo:
                for u in self.around(k):
                    if not seen[u]:
                        seen[u] = True
                        todo.append(u)
            out.append(np.sort(np.concatenate([self.member[self.first[k] : self.first[k + 1]] for k in todo])).tolist())
        return out


def neighbours_of(w: DataFrame, ids: list) -> Near:
    from lattix.operators.weights import edges_of_kinds, twins

    w = w.select("src", "dst", F.lit(1.0).alias("weight"))
    kind = twins(w, ids)
    a, b, _ = edges_of_kinds(w, ids, kind)
    number = np.unique(kind, return_inverse=True)[1].reshape(-1)
    return Near(len(ids), number[a], number[b], kind)


def alike(x: np.ndarray, near: Near) -> tuple[np.ndarray, Near, np.ndarray, np.ndarray]:
    """(values, neighbours, first place, group of every place): places of one kind and equal values, which merge before all others, as one; groups are numbered by their first places."""
    if near.kinds == len(near):
        return x, near, np.arange(len(x)), np.arange(len(x))
    _, first, group = np.unique(np.c_[near.kind, x], axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    first, group = first[order], rank[group.reshape(-1)]
    own = np.argsort(near.kind[first], kind="stable")
    at = np.searchsorted(near.kind[first][own], np.arange(near.kinds + 1))
    a, b = near.of(np.arange(near.kinds))
    a, b = np.r_[a, np.arange(near.kinds)], np.r_[b, np.arange(near.kinds)]
    pairs = [np.array(np.meshgrid(own[at[i] : at[i + 1]], own[at[j] : at[j + 1]])).reshape(2, -1) for i, j in zip(a.tolist(), b.tolist()) if i <= j]
    p, q = np.concatenate(pairs, axis=1)
    return x[first], Near(len(first), p, q), first, group


def _contiguous_linkage(x: np.ndarray, method: str, near: Near, mass: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Distances are kept for adjacent clusters alone; one that is asked for the first time is had from the members, so no pair of rows is looked at twice.  mass: how many equal rows each stands for."""
    n = len(x)
    a, b = near.of(np.arange(n))
    a, b = a[a < b], b[a < b]
    d = ((x[a] - x[b]) ** 2).sum(axis=1)
    size = [1] * n if mass is None else mass.tolist()
    if method == "ward" and mass is not None:
        d = 2 * mass[a] * mass[b] / (mass[a] + mass[b]) * d
    d = d if method == "ward" else np.sqrt(d)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    heap = list(zip(d.tolist(), a.tolist(), b.tolist()))
    for v, i, j in heap:
        links[i][j] = links[j][i] = v
    heapq.heapify(heap)
    member, label, sums, merges = [np.array([i]) for i in range(n)], list(range(n)), x.copy() if mass is None else x * mass[:, None], []

    def between(i: int, j: int) -> float:
        p, q = member[i], member[j]
        step = max(1, (1 << 20) // len(q))
        parts = (np.sqrt(((x[p[lo : lo + step], None] - x[q][None]) ** 2).sum(axis=2)) if x.shape[1] > 1 else np.abs(x[p[lo : lo + step]] - x[q, 0]) for lo in range(0, len(p), step))
        if method == "single":
            return float(min(v.min() for v in parts))
        if method == "complete":
            return float(max(v.max() for v in parts))
        if mass is None:
            return float(sum(v.sum() for v in parts) / (len(p) * len(q)))
        return float(sum(mass[p[lo : lo + step]] @ v @ mass[q] for lo, v in zip(range(0, len(p), step), parts)) / (size[i] * size[j]))

    while heap:
        far, i, j = heapq.heappop(heap)
        if links[i].get(j) != far:
            continue
        merges.append((label[i], label[j], far))
        one, two = links[i], links[j]
        del one[j], two[i]
        both = sums[i] + sums[j]
        new = {}
        for m in one.keys() | two.keys():
            if method == "ward":
                k = size[i] + size[j]
                gap = both / k - sums[m] / size[m]
                new[m] = float(2 * k * size[m] / (k + size[m]) * (gap @ gap))
                continue
            u = one[m] if m in one else between(i, m)
            v = two[m] if m in two else between(j, m)
            new[m] = min(u, v) if method == "single" else max(u, v) if method == "complete" else (size[i] * u + size[j] * v) / (size[i] + size[j])
        for m, v in new.items():
            links[m].pop(j, None)
            links[m][i] = v
            heapq.heappush(heap, (v, min(i, m), max(i, m)))
        links[i], links[j] = new, {}
        member[i], member[j] = np.concatenate([member[i], member[j]]), member[j][:0]
        size[i], sums[i] = size[i] + size[j], both
        label[i] = n + len(merges) - 1
    return merges


def linkage(x: np.ndarray, method: str, near: Near | None = None) -> list[tuple[int, int, float]]:
    """Agglomerative merges by Lance-Williams updates; near: only adjacent clusters merge."""
    if near is not None:
        few, near, first, group = alike(x, near)
        if len(few) == len(x):
            return _contiguous_linkage(x, method, near)
        n, name, merges = len(x), first.tolist(), []
        for i in np.setdiff1d(np.arange(n), first).tolist():
            merges.append((name[group[i]], i, 0.0))
            name[group[i]] = n + len(merges) - 1
        name += list(range(n + len(merges), 2 * n))
        return merges + [(name[a], name[b], far) for a, b, far in _contiguous_linkage(few, method, near, np.bincount(group))]
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    if method != "ward":
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, label, merges = np.ones(n), list(range(n)), []
    live = np.ones(n, bool)
    for step in range(n - 1):
        open_ = np.where(live[:, None] & live[None, :], d, np.inf)
        np.fill_diagonal(open_, np.inf)
        i, j = divmod(int(open_.argmin()), n)
        if not np.isfinite(open_[i, j]):
            break
        i, j = min(i, j), max(i, j)
        merges.append((label[i], label[j], float(d[i, j])))
        a, b = d[i], d[j]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
        elif method == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        live[j] = False
        size[i] += size[j]
        label[i] = n + step
    return merges


def cut_tree(n: int, merges: list, k: int) -> np.ndarray:
    """Cluster of each leaf after all but the last k - 1 merges."""
    group = {i: [i] for i in range(n)}
    for step, (a, b, _) in enumerate(merges[: max(0, n - k)]):
        group[n + step] = group.pop(a) + group.pop(b)
    out = np.zeros(n, int)
    for c, members in enumerate(sorted(group.values(), key=lambda m: (-len(m), min(m)))):
        out[members] = c + 1
    return out


def _contiguity(w: DataFrame, ids: list) -> np.ndarray:
    place = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)), bool)
    for r in w.select("src", "dst").collect():
        if r[0] in place and r[1] in place:
            m[place[r[0]], place[r[1]]] = True
    return m | m.T


def hierarchical(df: DataFrame, key: str, xs: list[str], k: int, method: str = "ward", w: DataFrame | None = None) -> DataFrame:
    """single, complete, average or ward; with weights, only contiguous clusters merge."""
    ids, x = standard_matrix(df, key, xs, MOST if w is None else None)
    return _table(df, key, ids, cut_tree(len(ids), linkage(x, method, None if w is None else neighbours_of(w, ids)), k))


def spanning_tree(x: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Prim's tree of the allowed pairs by squared distance (a forest if they do not connect)."""
    n, edges = len(x), []
    done = np.zeros(n, bool)
    best, back = np.full(n, np.inf), np.full(n, -1)
    for _ in range(n):
        i = int(np.where(done, np.inf, best).argmin())
        if done[i] or not np.isfinite(best[i]):
            i = int(np.flatnonzero(~done)[0])
        elif back[i] >= 0:
            edges.append((int(back[i]), i))
        done[i] = True
        d = ((x - x[i]) ** 2).sum(axis=1)
        closer = near[i] & ~done & (d < best)
        best[closer], back[closer] = d[closer], i
    return edges


def partition_tree(x: np.ndarray, edges: list[tuple[int, int]], k: int, least: int = 1) -> np.ndarray:
    """Cuts a spanning tree where the sum of squares falls most, until k parts of at least `least` rows each remain."""
    tree: dict[int, set[int]] = {i: set() for i in range(len(x))}
    for a, b in edges:
        tree[a].add(b)
        tree[b].add(a)

    def part_of(start: int) -> list[int]:
        seen, todo = {start}, [start]
        while todo:
            for v in tree[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return sorted(seen)

    def ssd(s: np.ndarray, q: float, n: int) -> float:
        return q - (s * s).sum() / n if n else 0.0

    def best_cut(members: list[int]) -> tuple[float, tuple[int, int] | None]:
        root, order, parent = members[0], [], {members[0]: -1}
        todo = [root]
        while todo:
            v = todo.pop()
            order.append(v)
            for u in tree[v]:
                if u not in parent:
                    parent[u] = v
                    todo.append(u)
        sums = {v: (x[v].copy(), float((x[v] ** 2).sum()), 1) for v in members}
        for v in reversed(order[1:]):
            s, q, n = sums[v]
            ps, pq, pn = sums[parent[v]]
            sums[parent[v]] = (ps + s, pq + q, pn + n)
        s0, q0, n0 = sums[root]
        top, edge = 0.0, None
        for v in order[1:]:
            s, q, n = sums[v]
            gain = ssd(s0, q0, n0) - ssd(s, q, n) - ssd(s0 - s, q0 - q, n0 - n)
            if n >= least and n0 - n >= least and gain > top + 1e-12:
                top, edge = gain, (parent[v], v)
        return top, edge

    parts, seen = [], set()
    for i in range(len(x)):
        if i not in seen:
            parts.append(part_of(i))
            seen.update(parts[-1])
    cuts = [best_cut(p) for p in parts]
    while len(parts) < k:
        at = max(range(len(parts)), key=lambda i: cuts[i][0])
        if cuts[at][1] is None:
            break
        a, b = cuts[at][1]
        tree[a].discard(b)
        tree[b].discard(a)
        parts[at] = part_of(a)
        parts.append(part_of(b))
        cuts[at] = best_cut(parts[at])
        cuts.append(best_cut(parts[-1]))
    labels = np.zeros(len(x), int)
    for c, p in enumerate(sorted(parts, key=lambda p: (-len(p), p[0]))):
        labels[p] = c + 1
    return labels


def skater(df: DataFrame, key: str, xs: list[str], k: int, w: DataFrame, least: int = 1) -> DataFrame:
    """Parts of the contiguity graph's minimum spanning tree; parts hold at least `least` rows."""
    ids, x = standard_matrix(df, key, xs)
    return _table(df, key, ids, partition_tree(x, spanning_tree(x, _contiguity(w, ids)), k, least))


def pca(df: DataFrame, key: str, xs: list[str], components: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(variance shares, loadings, scores) of standardized columns; each component's largest loading is positive."""
    from lattix.operators.autocorr import standardized
    from lattix.operators.regression import cross

    d = _features(df, key, xs)
    cols = [c for c in d.columns if c != "id"]
    d = standardized(d, *cols).fillna(0.0)
    n = scalars(d, n=F.count("*"))["n"]
    values, vectors = np.linalg.eigh(cross(d, cols) / (n - 1))
    order = np.argsort(-values)[:components]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    scores = [sum((F.col(c) * float(w) for c, w in zip(cols, v[:, j])), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(v.shape[1])]
    return values[order] / values.sum(), v, d.select(F.col("id").alias(key), *scores)


def classic_mds(df: DataFrame, key: str, xs: list[str], dims: int = 2) -> DataFrame:
    """Classic scaling of euclidean distances: their double-centred matrix is the centred rows times themselves, so its vectors are had from the columns' products.
    The entry of largest size (of equals, that of the least key) is positive; dimensions beyond the columns are 0."""
    from lattix.operators.regression import cross

    d = _features(df, key, xs)
    cols = [c for c in d.columns if c != "id"]
    names = [f"dim{i + 1}" for i in range(dims)]
    s = scalars(d, n=F.count("*"), **{c: F.avg(c) for c in cols})
    if not s["n"]:
        return d.select(F.col("id").alias(key), *[F.lit(0.0).alias(v) for v in names])
    d = d.select("id", *[(F.col(c) - s[c]).alias(c) for c in cols])
    values, vectors = np.linalg.eigh(cross(d, cols))
    v = vectors[:, np.argsort(-values)[:dims]]
    p = d.select("id", *[(sum((F.col(c) * float(w) for c, w in zip(cols, v[:, j])), F.lit(0.0)) if j < v.shape[1] else F.lit(0.0)).alias(m) for j, m in enumerate(names)])
    far = p.agg(*[F.max(F.abs(m)).alias(m) for m in names]).first()
    ends = p.agg(*[F.min(F.when(F.abs(m) >= far[m] * (1 - 1e-12), F.struct("id", m))).alias(m) for m in names]).first()
    return p.select(F.col("id").alias(key), *[(F.col(m) * (-1.0 if ends[m][1] < 0 else 1.0)).alias(m) for m in names])


def sum_of_squares(df: DataFrame, cluster: str, xs: list[str]) -> dict[str, float]:
    """Total, within and between sum of squares of standardized columns, and the between share."""
    from lattix.operators.autocorr import standardized

    d = standardized(df.select(cluster, *xs).dropna(), *xs)
    parts = d.groupBy(cluster).agg(*[(F.var_pop(x) * F.count(x)).alias(x) for x in xs])
    within = sum(v for r in [parts.agg(*[F.sum(x) for x in xs]).first()] for v in r)
    total = sum(v for v in d.agg(*[F.var_pop(x) * F.count(x) for x in xs]).first())
    return {"total": total, "within": within, "between": total - within, "ratio": 1 - within / total}
