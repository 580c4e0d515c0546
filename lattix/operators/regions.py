"""Regions under contiguity (spatial k-means, REDCAP, AZP, max-p) and validation of clusterings.

The searches are sequential: each runs as one task over all rows and their neighbour
lists; random restarts are spread over tasks.  Spatial k-means takes at most cluster.MOST rows.  Fragmentation,
sums of squares and compactness are joins and grouped aggregates and have no bound.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators.cluster import Near, _collect, _contiguity, _contiguous_linkage, _table, alike, neighbours_of, partition_tree, standard_matrix


def _lists(near: np.ndarray) -> list[list[int]]:
    return [np.flatnonzero(row).tolist() for row in near]


def pieces(members: list[int], near: Near | list[list[int]]) -> list[list[int]]:
    """Connected parts of a set of places."""
    left, out = set(members), []
    for first in sorted(members):
        if first not in left:
            continue
        todo = [first]
        left.discard(first)
        for v in todo:
            for u in near[v]:
                if u in left:
                    left.discard(u)
                    todo.append(u)
        out.append(sorted(todo))
    return out


class Zones:
    """A partition with the sums that give each zone's sum of squares; moves keep zones contiguous and above the floor."""

    def __init__(self, x: np.ndarray, near: Near | list[list[int]], label: np.ndarray, mass: np.ndarray, floor: float):
        if not isinstance(near, Near):
            near = Near(len(near), *np.array([(i, j) for i, row in enumerate(near) for j in row], np.int64).reshape(-1, 2).T)
        self.x, self.near, self.label, self.mass, self.floor = x, near, label.tolist(), mass.tolist(), floor
        self.kind, self.around = near.kind.tolist(), [near.around(k) for k in range(near.kinds)]
        self.held: list[dict[int, int]] = [{} for _ in range(near.kinds)]  # how many places of a kind have each label
        for k, c in zip(self.kind, self.label):
            self.held[k][c] = self.held[k].get(c, 0) + 1
        self.rows, self.square = x.tolist(), (x * x).sum(axis=1).tolist()
        self.members: dict[int, set[int]] = {}
        for i, c in enumerate(self.label):
            if c > 0:
                self.members.setdefault(c, set()).add(i)
        self.sums = {c: [x[sorted(m)].sum(axis=0).tolist(), sum(self.square[i] for i in sorted(m)), len(m)] for c, m in self.members.items()}
        self.weight = {c: float(mass[sorted(m)].sum()) for c, m in self.members.items()}
        self.edges = None

    @staticmethod
    def _ssd(s: list[float], q: float, n: int) -> float:
        return q - sum(v * v for v in s) / n if n else 0.0

    def cost(self) -> float:
        return sum(self._ssd(*v) for v in self.sums.values())

    def _with(self, i: int, c: int, sign: int) -> float:
        s, q, n = self.sums[c]
        return self._ssd([u + sign * v for u, v in zip(s, self.rows[i])], q + sign * self.square[i], n + sign) - self._ssd(s, q, n)

    def change(self, i: int, to: int) -> float:
        return self._with(i, self.label[i], -1) + self._with(i, to, 1)

    def moves(self) -> list[tuple[float, int, int]]:
        """(change, place, zone) of all moves over a border, best first."""
        near = self.near
        if self.edges is None:
            a, b = near.of(np.arange(near.kinds))
            self.edges = np.r_[a, np.arange(near.kinds)], np.r_[b, np.arange(near.kinds)]
        label, (a, b) = np.array(self.label, np.int64), self.edges
        wide = int(label.max()) + 1
        held = np.unique(near.kind * wide + label)
        k, c = held // wide, held % wide
        start = np.searchsorted(k, np.arange(near.kinds + 1))
        many = np.diff(start)
        sole = np.where(many == 1, c[start[:-1]], -1)
        at = np.repeat(start[b] - np.r_[0, np.cumsum(many[b])[:-1]], many[b]) + np.arange(many[b].sum())
        a, to = np.repeat(a, many[b]), c[at]
        border = (to > 0) & (sole[a] != to) & (sole[a] != 0)
        code = np.unique(a[border] * wide + to[border])
        a, to = code // wide, code % wide
        many = np.diff(near.first)[a]
        i = near.member[np.repeat(near.first[a] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())] if len(a) else a
        to = np.repeat(to, many)
        keep = (label[i] > 0) & (label[i] != to)
        if not keep.any():
            return []
        i, to = i[keep], to[keep]
        s, q, n = np.zeros((wide, self.x.shape[1])), np.zeros(wide), np.zeros(wide)
        for c, (u, v, m) in self.sums.items():
            s[c], q[c], n[c] = u, v, m
        ssd = lambda s, q, n: np.where(n > 0, q - (s * s).sum(axis=1) / np.maximum(n, 1), 0.0)
        x, square, c = self.x[i], np.array(self.square)[i], label[i]
        change = ssd(s[c] - x, q[c] - square, n[c] - 1) - ssd(s[c], q[c], n[c]) + (ssd(s[to] + x, q[to] + square, n[to] + 1) - ssd(s[to], q[to], n[to]))
        order = np.lexsort((to, i, change))
        return zip(change[order].tolist(), i[order].tolist(), to[order].tolist())

    def may_leave(self, i: int) -> bool:
        c = self.label[i]
        if len(self.members[c]) < 2:
            return False
        rest = self.weight[c] - self.mass[i]
        if abs(rest - self.floor) <= 1e-9 * max(1.0, abs(self.floor)):
            rest = np.array([self.mass[j] for j in sorted(self.members[c] - {i})]).sum()
        return rest >= self.floor and self._holds(i)

    def _holds(self, i: int) -> bool:
        """Whether the zone stays connected without i: searches from all its neighbours in the zone grow in turn until they have met or one ends alone.  Another place of its kind has the same neighbours."""
        held, own, c = self.held, self.kind[i], self.label[i]
        if held[own][c] > 1:
            return True
        starts = [k for k in self.around[own] if c in held[k]]
        root = list(range(len(starts)))
        owner = {j: f for f, j in enumerate(starts)}
        todo = [[j] for j in starts]
        apart = len(starts)

        def find(f: int) -> int:
            while root[f] != f:
                root[f] = root[root[f]]
                f = root[f]
            return f

        turn = list(root)
        while apart > 1:
            after = []
            for f in turn:
                if root[f] != f:
                    continue
                if not todo[f]:
                    return False
                for u in self.around[todo[f].pop()]:
                    if c not in held[u] or u == own:
                        continue
                    g = find(owner[u]) if u in owner else None
                    if g is None:
                        owner[u] = f
                        todo[f].append(u)
                    elif g != f:
                        root[g] = f
                        if len(todo[g]) > len(todo[f]):
                            todo[f], todo[g] = todo[g], todo[f]
                        todo[f] += todo[g]
                        apart -= 1
                if apart == 1:
                    return True
                after.append(f)
            turn = after
        return apart == 1

    def targets(self, i: int) -> list[int]:
        held, k = self.held, self.kind[i]
        return sorted(set(held[k]).union(*[held[u] for u in self.around[k]]) - {self.label[i], 0})

    def join(self, i: int, to: int) -> None:
        s = self.sums[to]
        s[0], s[1], s[2] = [u + v for u, v in zip(s[0], self.rows[i])], s[1] + self.square[i], s[2] + 1
        self.weight[to] += self.mass[i]
        self.members[to].add(i)
        held, old = self.held[self.kind[i]], self.label[i]
        held[old] -= 1
        if not held[old]:
            del held[old]
        held[to] = held.get(to, 0) + 1
        self.label[i] = to

    def move(self, i: int, to: int) -> None:
        a = self.label[i]
        s = self.sums[a]
        s[0], s[1], s[2] = [u - v for u, v in zip(s[0], self.rows[i])], s[1] - self.square[i], s[2] - 1
        self.weight[a] -= self.mass[i]
        self.members[a].discard(i)
        self.join(i, to)


def improve(z: Zones, method: str, rng: np.random.Generator, tabu: int = 10, patience: int = 30, cooling: float = 0.85) -> tuple[float, np.ndarray]:
    """Local search by moves of border places: greedy descent, tabu, or annealing followed by descent."""
    if method not in ("greedy", "tabu", "annealing"):
        raise ValueError(f"unknown search {method}")
    n = len(z.label)
    if method == "annealing" and n:
        scale, heat = max(z.cost() / max(n, 1), 1e-12), 1.0
        while heat > 0.01:
            for i in rng.permutation(n).tolist():
                to = z.targets(i) if z.label[i] > 0 else []
                if not to:
                    continue
                c = to[int(rng.integers(len(to)))]
                change = z.change(i, c)
                if (change < 0 or rng.random() < math.exp(-change / (scale * heat))) and z.may_leave(i):
                    z.move(i, c)
            heat *= cooling
    moved = True
    while moved:
        moved = False
        for i in rng.permutation(n).tolist():
            best = min(((z.change(i, c), c) for c in z.targets(i)), default=(0.0, 0)) if z.label[i] > 0 else (0.0, 0)
            if best[0] < -1e-10 and z.may_leave(i):
                z.move(i, best[1])
                moved = True
    best_cost, best_label = z.cost(), np.array(z.label)
    if method == "tabu":
        banned: list[tuple[int, int]] = []
        idle = 0
        while idle < patience:
            now = z.cost()
            for change, i, c in z.moves():
                if ((i, c) not in banned or now + change < best_cost - 1e-10) and z.may_leave(i):
                    banned = [*banned, (i, int(z.label[i]))][-tabu:]
                    z.move(i, c)
                    break
            else:
                break
            idle += 1
            if z.cost() < best_cost - 1e-10:
                best_cost, best_label, idle = z.cost(), np.array(z.label), 0
    return best_cost, best_label


def _grow(label: np.ndarray, near: Near, rng: np.random.Generator) -> np.ndarray:
    """Spreads labelled places over unlabelled (-1) ones, one random step over a border at a time; a step ends at the first unlabelled place of a kind."""
    label = label.tolist()
    free = [[i for i in reversed(near.member[near.first[k] : near.first[k + 1]].tolist()) if label[i] == -1] for k in range(near.kinds)]
    around = [[k] * (size > 1) + near.around(k) for k, size in enumerate(np.diff(near.first).tolist())]
    kind = near.kind.tolist()
    front = [(label[i], k) for i in range(len(label)) if label[i] > 0 for k in around[kind[i]]]
    while front:
        at = int(rng.integers(len(front)))
        front[at], front[-1] = front[-1], front[at]
        c, k = front[-1]
        if free[k]:
            label[free[k].pop()] = c
            if not free[k]:
                front.pop()
            front += [(c, u) for u in around[k] if free[u]]
        else:
            front.pop()
    return np.array(label)


def _start_azp(near: Near, k: int, rng: np.random.Generator) -> np.ndarray:
    parts = near.parts()
    if k < len(parts) or k > len(near):
        raise ValueError(f"{k} zones cannot cover {len(parts)} unconnected parts of {len(near)} places")
    seeds = [p[int(rng.integers(len(p)))] for p in parts]
    taken = set(seeds)
    rest = [i for i in rng.permutation(len(near)).tolist() if i not in taken]
    label = np.full(len(near), -1)
    label[seeds + rest[: k - len(seeds)]] = np.arange(1, k + 1)
    return _grow(label, near, rng)


def _start_max_p(x: np.ndarray, near: Near, mass: np.ndarray, floor: float, rng: np.random.Generator) -> np.ndarray:
    """Grows zones from random places until each reaches the floor; what is left joins the neighbouring zone it disturbs least.  0: a part too small for any zone."""
    label, c = np.full(len(near), -1), 0
    for seed in rng.permutation(len(near)).tolist():
        if label[seed] != -1:
            continue
        zone, inside, total, front = [seed], {seed}, mass[seed], [u for u in near[seed] if label[u] == -1]
        while total < floor and front:
            u = front.pop(int(rng.integers(len(front))))
            if u in inside:
                continue
            zone.append(u)
            inside.add(u)
            total += mass[u]
            front += [v for v in near[u] if label[v] == -1 and v not in inside]
        if total >= floor:
            c += 1
            label[zone] = c
    z = Zones(x, near, np.maximum(label, 0), mass, floor)
    todo = np.flatnonzero(label == -1).tolist()
    while todo:
        left = []
        for i in todo:
            to = z.targets(i)
            if not to:
                left.append(i)
                continue
            z.join(i, min(to, key=lambda t: (z._with(i, t, 1), t)))
        if len(left) == len(todo):
            break
        todo = left
    return np.array(z.label)


def _restarts(df: DataFrame, tries: int, one) -> np.ndarray:
    """Runs one(seed) -> (zones, cost, labels) for each try, spread over tasks; most zones win, then the least cost, then the first try."""

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            rows = [(int(s), *one(int(s))) for s in pdf["id"]]
            yield pd.DataFrame([(s, int(p), float(c), [int(v) for v in lab]) for s, p, c, lab in rows], columns=["try", "p", "cost", "labels"])

    found = df.sparkSession.range(0, tries, 1, tries).mapInPandas(run, "try long, p int, cost double, labels array<int>")
    return np.array(found.orderBy(F.desc("p"), F.round("cost", 9), "try").first()["labels"], int)


def _by_size(label: np.ndarray) -> np.ndarray:
    """Zones renumbered 1, 2, ... by falling size, then first place; 0 stays."""
    order = sorted({int(c) for c in label if c > 0}, key=lambda c: (-(label == c).sum(), int(np.flatnonzero(label == c)[0])))
    new = {c: i + 1 for i, c in enumerate(order)} | {0: 0}
    return np.array([new[int(c)] for c in label], int)


def redcap(df: DataFrame, key: str, xs: list[str], k: int, w: DataFrame, method: str = "ward", least: int = 1) -> DataFrame:
    """Full-order REDCAP: constrained linkage (single, complete, average, ward) joins the zones by their shortest edge; the tree of those edges is cut as in SKATER."""
    ids, x = standard_matrix(df, key, xs, None)
    if not ids:
        return _table(df, key, [], [])
    few, near, first, group = alike(x, neighbours_of(w, ids))
    merges = _contiguous_linkage(few, method, near, None if len(few) == len(x) else np.bincount(group))
    edges = [(int(first[a]), int(first[b])) for a, b in _shortest_edges(few, near, merges)]
    edges += [(int(first[group[i]]), i) for i in np.setdiff1d(np.arange(len(x)), first).tolist()]
    return _table(df, key, ids, partition_tree(x, edges, k, least))


def _shortest_edges(x: np.ndarray, near: Near, merges: list) -> list[tuple[int, int]]:
    """Of every merge, the shortest edge between its two zones: zones are ranges of the leaves' order, and the edges of the smaller are looked at."""
    n, size = len(x), [1] * len(x)
    for a, b, _ in merges:
        size.append(size[a] + size[b])
    low, below = [0] * len(size), {v for a, b, _ in merges for v in (a, b)}
    at = 0
    for v in range(len(size)):
        if v not in below:
            low[v], at = at, at + size[v]
    for step in reversed(range(len(merges))):
        a, b, _ = merges[step]
        low[a], low[b] = low[n + step], low[n + step] + size[a]
    place, edges = np.array(low[:n], int), []
    leaf = np.argsort(place)
    for a, b, _ in merges:
        s, o = (a, b) if size[a] <= size[b] else (b, a)
        p, q = near.of(leaf[low[s] : low[s] + size[s]])
        hit = (place[q] >= low[o]) & (place[q] < low[o] + size[o])
        p, q = (p[hit], q[hit]) if s == a else (q[hit], p[hit])
        best = np.lexsort((place[q], place[p], ((x[p] - x[q]) ** 2).sum(axis=1)))[0]
        edges.append((int(p[best]), int(q[best])))
    return edges


def make_spatial(df: DataFrame, key: str, cluster: str, xs: list[str], w: DataFrame) -> DataFrame:
    """Keeps each cluster's largest connected part and moves the others, smallest first, to the neighbouring cluster they disturb least; a part without another neighbour stays."""
    rows, x = standard_matrix(df.where(F.col(cluster).isNotNull()), key, [*xs, cluster])
    x = x[:, :-1]
    code = {r[0]: int(r[1]) for r in df.where(F.col(cluster).isNotNull()).select(key, cluster).collect()}
    label = np.array([code[i] for i in rows], int)
    label = np.unique(label, return_inverse=True)[1].reshape(-1) + 1 if len(label) else label
    near = _lists(_contiguity(w, rows))
    for _ in range(len(rows)):
        loose = []
        for c in np.unique(label):
            parts = sorted(pieces(np.flatnonzero(label == c).tolist(), near), key=lambda p: (-len(p), p[0]))
            loose += parts[1:]
        done = True
        for part in sorted(loose, key=lambda p: (len(p), p[0])):
            to = sorted({int(label[j]) for i in part for j in near[i]} - {int(label[part[0]])})
            if to:
                centre = x[part].mean(axis=0)
                m = lambda t: (label == t).sum()
                label[part] = min(to, key=lambda t: (m(t) * len(part) / (m(t) + len(part)) * ((x[label == t].mean(axis=0) - centre) ** 2).sum(), t))
                done = False
                break
        if done:
            break
    return _table(df, key, rows, _by_size(label))


def spatial_kmeans(df: DataFrame, key: str, xs: list[str], k: int, w: DataFrame, seed: int = 1) -> DataFrame:
    """K-means, then made contiguous."""
    from lattix.operators.cluster import kmeans

    return make_spatial(df.join(kmeans(df, key, xs, k, seed).withColumnRenamed("cluster", "__c"), key), key, "__c", xs, w)


def azp(df: DataFrame, key: str, xs: list[str], k: int, w: DataFrame, method: str = "greedy", tries: int = 4, seed: int = 1, control: str | None = None, floor: float = 0.0) -> DataFrame:
    """Automatic zoning: k contiguous zones from random starts, bettered by greedy, tabu or annealing moves; control: a column whose sum must stay at least `floor` where a zone gives a place away."""
    ids, x, mass = _with_mass(df, key, xs, control)
    near = neighbours_of(w, ids)
    if not ids:
        return _table(df, key, [], [])

    def one(s: int):
        rng = np.random.default_rng(seed * 1_000_003 + s)
        cost, label = improve(Zones(x, near, _start_azp(near, k, rng), mass, floor), method, rng)
        return k, cost, label

    return _table(df, key, ids, _by_size(_restarts(df, tries, one)))


def max_p(df: DataFrame, key: str, xs: list[str], w: DataFrame, control: str | None, floor: float, method: str = "greedy", tries: int = 8, seed: int = 1) -> DataFrame:
    """As many contiguous zones as possible whose control column (None: rows) sums to the floor; 0 for places of a connected part below the floor."""
    ids, x, mass = _with_mass(df, key, xs, control)
    near = neighbours_of(w, ids)
    if not ids:
        return _table(df, key, [], [])

    def one(s: int):
        rng = np.random.default_rng(seed * 1_000_003 + s)
        z = Zones(x, near, _start_max_p(x, near, mass, floor, rng), mass, floor)
        cost, label = improve(z, method, rng)
        return len(z.members), cost, label

    return _table(df, key, ids, _by_size(_restarts(df, tries, one)))


def _with_mass(df: DataFrame, key: str, xs: list[str], control: str | None):
    d = df if control is None else df.where(F.col(control).isNotNull())
    ids, x = standard_matrix(d, key, xs, None)
    mass = np.ones(len(ids)) if control is None or not ids else _collect(d.dropna(subset=xs), key, [control], None)[1][:, 0]
    return ids, x, mass


def fragmentation(obs: DataFrame, key: str, cluster: str, w: DataFrame) -> DataFrame:
    """(cluster, n, parts, entropy, entropy_std, simpson): connected parts of each cluster and the evenness of their sizes (0 for a single part)."""
    from lattix.operators.graph import connected_components

    c = obs.where(F.col(cluster).isNotNull()).select(F.col(key).alias("id"), F.col(cluster).alias("cluster"))
    own = w.where("src <> dst").join(c.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst").where("a = b")
    comp = connected_components(own.select("src", "dst")).select(F.col("node").alias("id"), "component")
    part = c.join(comp, "id", "left").groupBy("cluster", F.coalesce("component", "id").alias("part")).agg(F.count("*").alias("m"))
    total = part.groupBy("cluster").agg(F.sum("m").alias("n"))
    p = F.col("m") / F.col("n")
    g = part.join(total, "cluster").groupBy("cluster", "n").agg(F.count("*").alias("parts"), F.sum(-p * F.ln(p)).alias("entropy"), F.sum(p * p).alias("simpson"))
    even = F.when(F.col("parts") > 1, F.col("entropy") / F.ln("parts")).otherwise(0.0)
    return g.select("cluster", "n", "parts", F.col("entropy"), even.alias("entropy_std"), "simpson")


def compactness(polys: DataFrame, key: str, cluster: str, rings: str = "rings") -> DataFrame:
    """(cluster, area, perimeter, quotient): 4 pi area / perimeter^2 of each cluster's union; shared borders of edge-matched polygons do not count."""
    from lattix.operators.table import ring_area

    d = polys.select(F.col(cluster).alias("cluster"), F.col(rings).alias("rings"))
    area = d.groupBy("cluster").agg(F.sum(F.abs(F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, b: a + b))).alias("area"))
    ring = d.select("cluster", F.explode("rings").alias("r"))
    seg = ring.select("cluster", F.explode(F.transform("r", lambda v, i: F.array(v, F.element_at("r", F.pmod(i + 1, F.size("r")) + 1)))).alias("s"))
    seg = seg.select("cluster", F.array_sort("s").alias("s")).where(F.col("s")[0] != F.col("s")[1])
    edge = seg.groupBy("cluster", "s").agg(F.count("*").alias("n")).where("n = 1")
    length = edge.groupBy("cluster").agg(F.sum(F.hypot(F.col("s")[0]["x"] - F.col("s")[1]["x"], F.col("s")[0]["y"] - F.col("s")[1]["y"])).alias("perimeter"))
    return area.join(length, "cluster", "left").withColumn("quotient", 4 * math.pi * F.col("area") / F.nullif(F.pow("perimeter", F.lit(2.0)), F.lit(0.0)))


def diameter(obs: DataFrame, key: str, cluster: str, w: DataFrame) -> DataFrame:
    """(cluster, n, steps): the longest shortest path, in steps between neighbours of the cluster (each cluster is one task; of an unconnected cluster, the longest within a part)."""
    c = obs.where(F.col(cluster).isNotNull()).select(F.col(key).alias("id"), F.col(cluster).cast("long").alias("cluster"))
    own = w.where("src <> dst").join(c.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst").where("a = b")
    rows = c.join(own.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near")), "id", "left")

    def run(g):
        import pandas as pd

        near = {i: list(v) if v is not None else [] for i, v in zip(g["id"], g["near"])}
        far = 0
        for start in near:
            depth, todo = {start: 0}, [start]
            for v in todo:
                for u in near[v]:
                    if u not in depth:
                        depth[u] = depth[v] + 1
                        todo.append(u)
            far = max(far, depth[todo[-1]])
        return pd.DataFrame({"cluster": [int(g["cluster"].iloc[0])], "n": [len(g)], "steps": [far]})

    return rows.groupBy("cluster").applyInPandas(lambda g: run(g), "cluster long, n long, steps int")
