"""Shapes against shapes, selection by shape, Delaunay and Voronoi, circle cartograms.

Shape joins meet by grid cells: a shape is dealt to the cells its box covers, and a
pair is tested only in the cell where both boxes begin, so no pair is made twice.
Delaunay, Voronoi and the cartogram are sequential: one task; Voronoi edges between points that share places are joined by the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.cluster import _collect
from lattix.operators.table import inside


def _segments(path: Column, closed: bool) -> Column:
    last = F.size(path)
    segs = F.transform(path, lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.element_at(path, F.pmod(i + 1, last) + 1)["x"].alias("x2"), F.element_at(path, F.pmod(i + 1, last) + 1)["y"].alias("y2")))
    return segs if closed else F.slice(segs, 1, F.greatest(last - 1, F.lit(0)))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(s: Column, t: Column) -> Column:
    """Whether two segments share a point (touching counts)."""
    a, b = (s["x1"], s["y1"], s["x2"], s["y2"]), (t["x1"], t["y1"], t["x2"], t["y2"])
    t1, t2, t3, t4 = _turn(*a, *b[:2]), _turn(*a, *b[2:]), _turn(*b, *a[:2]), _turn(*b, *a[2:])
    boxes = (F.greatest(a[0], a[2]) >= F.least(b[0], b[2])) & (F.greatest(b[0], b[2]) >= F.least(a[0], a[2])) & (F.greatest(a[1], a[3]) >= F.least(b[1], b[3])) & (F.greatest(b[1], b[3]) >= F.least(a[1], a[3]))
    return boxes & (t1 * t2 <= 0) & (t3 * t4 <= 0)


def shape_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, a_shape: str = "rings", b_rings: str = "rings", lines: bool = False) -> DataFrame:
    """(a, b) of every shape of a that meets a polygon of b; lines: a holds one path (array of x, y) instead of rings."""
    shape = F.array(a_shape) if lines else F.col(a_shape)

    def dealt(df: DataFrame, key: str, rings: Column, closed: bool, p: str) -> DataFrame:
        d = df.where(F.size(F.flatten(rings)) > 0).select(F.col(key).alias(p), rings.alias(f"{p}_rings"))
        flat = F.flatten(f"{p}_rings")
        edge = lambda f, c: F.floor(f(F.transform(flat, lambda v: v[c])) / cell)
        d = d.select("*", F.flatten(F.transform(f"{p}_rings", lambda r: _segments(r, closed))).alias(f"{p}_segs"), edge(F.array_min, "x").alias(f"{p}_x"), edge(F.array_min, "y").alias(f"{p}_y"), edge(F.array_max, "x").alias("__x1"), edge(F.array_max, "y").alias("__y1"))
        d = d.select("*", F.explode(F.sequence(f"{p}_x", "__x1")).alias("cx"))
        return d.select("*", F.explode(F.sequence(f"{p}_y", "__y1")).alias("cy")).drop("__x1", "__y1")

    j = dealt(a, a_key, shape, not lines, "a").join(dealt(b, b_key, F.col(b_rings), True, "b"), ["cx", "cy"])
    j = j.where((F.col("cx") == F.greatest("a_x", "b_x")) & (F.col("cy") == F.greatest("a_y", "b_y")))
    cross = F.exists("a_segs", lambda s: F.exists("b_segs", lambda t: segments_meet(s, t)))
    first = lambda p: F.col(f"{p}_rings")[0][0]
    within = inside(first("a")["x"], first("a")["y"], "b_rings")
    if not lines:
        within = within | inside(first("b")["x"], first("b")["y"], "a_rings")
    return j.where(cross | within).select("a", "b")


def count_shapes(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, lines: bool = False, **names) -> DataFrame:
    """Per polygon of b: how many lines or polygons of a meet it."""
    n = shape_pairs(a, b, a_key, b_key, cell, lines=lines, **names).groupBy(F.col("b").alias(b_key)).agg(F.count("*").alias("n_shapes"))
    return b.select(b_key).join(n, b_key, "left").fillna(0, ["n_shapes"])


def assign_shapes(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, lines: bool = False, **names) -> DataFrame:
    """(a_key, polygon): the largest id of the polygons a shape meets, -1 where none."""
    hit = shape_pairs(a, b, a_key, b_key, cell, lines=lines, **names).groupBy(F.col("a").alias(a_key)).agg(F.max("b").alias("polygon"))
    return a.select(a_key).join(hit, a_key, "left").select(a_key, F.coalesce("polygon", F.lit(-1)).alias("polygon"))


def select_rectangle(df: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(min(x0, x1), max(x0, x1)) & F.col(y).between(min(y0, y1), max(y0, y1)))


def select_circle(df: DataFrame, cx: float, cy: float, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    box = select_rectangle(df, cx - radius, cy - radius, cx + radius, cy + radius, x, y)
    return box.where((F.col(x) - cx) ** 2 + (F.col(y) - cy) ** 2 <= radius * radius)


def select_polygon(df: DataFrame, corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Points inside a drawn polygon (even-odd rule)."""
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in corners])
    return df.where(inside(F.col(x).cast("double"), F.col(y).cast("double"), F.array(ring)))


def select_line(df: DataFrame, x0: float, y0: float, x1: float, y1: float, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points at most `reach` from a drawn segment."""
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - x0) * dx + (F.col(y) - y0) * dy) / F.lit(float(dx * dx + dy * dy or 1.0))))
    return df.where(F.hypot(F.col(x) - (x0 + t * dx), F.col(y) - (y0 + t * dy)) <= reach)


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row with the bounding box and its diagonal."""
    e = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    return e.withColumn("diagonal", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def triangulate(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Delaunay triangles of distinct points by insertion, with their circumcentres; corners of the outer triangle are n, n + 1, n + 2."""
    n = len(p)
    mid, wide = (p.min(axis=0) + p.max(axis=0)) / 2, max(float(np.ptp(p, axis=0).max()), 1e-9)
    q = np.vstack([(p - mid) / wide, [[-300.0, -171.0], [311.0, -163.0], [7.0, 331.0]]])

    def circle(t: np.ndarray) -> np.ndarray:
        a, b, c = q[t[:, 0]], q[t[:, 1]], q[t[:, 2]]
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d = np.where(d == 0, 1e-300, d)
        bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
        u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], axis=1)
        return np.column_stack([u + a, (u * u).sum(axis=1)])

    tri = np.array([[n, n + 1, n + 2]])
    rings = circle(tri)
    for i in range(n):
        gap = ((rings[:, :2] - q[i]) ** 2).sum(axis=1) - rings[:, 2]
        hit = gap < -1e-12 * np.maximum(1.0, rings[:, 2])
        if not hit.any():
            hit[int(gap.argmin())] = True
        t = tri[hit]
        edges = np.sort(np.vstack([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1)
        rim, seen = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([rim[seen == 1], np.full((seen == 1).sum(), i)])
        tri, rings = np.vstack([tri[~hit], new]), np.vstack([rings[~hit], circle(new)])
    return tri, rings[:, :2] * wide + mid


def _sites(points: DataFrame, key: str, x: str, y: str):
    ids, p = _collect(points, key, [x, y], None)
    sites, place = np.unique(p, axis=0, return_inverse=True) if len(ids) else (np.zeros((0, 2)), np.zeros(0, int))
    return ids, sites, place.reshape(-1)


def _neighbours(sites: np.ndarray, queen: bool) -> set[tuple[int, int]]:
    n = len(sites)
    if n < 2:
        return set()
    tri, centre = triangulate(sites)
    step = max(float(np.ptp(sites, axis=0).max()), 1e-9) * 1e-7
    corner = np.round(centre / step).astype(np.int64)
    at: dict[tuple[int, int], list] = {}
    for t, c in zip(tri.tolist(), corner.tolist()):
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            at.setdefault((min(a, b), max(a, b)), []).append(tuple(c))
    out = {e for e, cs in at.items() if e[1] < n and max(abs(u - v) for u, v in zip(cs[0], cs[-1])) > 1 or e[1] < n and len(cs) == 1}
    if queen:
        shared: dict[tuple, set[int]] = {}
        for t, c in zip(tri.tolist(), corner.tolist()):
            shared.setdefault(tuple(v // 4 for v in c), set()).update(v for v in t if v < n)
        out |= {(a, b) for s in shared.values() for a in s for b in s if a < b} | {e for e in at if e[1] < n}
    return out


def voronoi_weights(points: DataFrame, key: str, queen: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Contiguity of points whose Voronoi cells share an edge (queen: or a corner).  Cells are not clipped; points at one place are neighbours of each other and share their cell's neighbours."""
    ids, sites, place = _sites(points, key, x, y)
    spark, t = points.sparkSession, points.schema[key].dataType.simpleString()
    links = [e for a, b in sorted(_neighbours(sites, queen)) for e in ((a, b), (b, a))] + [(s, s) for s in range(len(sites))]
    at = spark.createDataFrame(list(zip(ids, place.tolist())), f"src {t}, a long")
    pairs = at.join(spark.createDataFrame(links, "a long, b long"), "a").join(at.select(F.col("src").alias("dst"), F.col("a").alias("b")), "b")
    return pairs.where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))


def voronoi_polygons(points: DataFrame, key: str, x: str = "x", y: str = "y", margin: float = 0.02) -> DataFrame:
    """(key, rings): Voronoi cells clipped to the points' box widened by `margin`; points at one place share a cell."""
    ids, sites, place = _sites(points, key, x, y)
    t = points.schema[key].dataType.simpleString()
    schema = f"{key} {t}, rings array<array<struct<x:double,y:double>>>"
    if not ids:
        return points.sparkSession.createDataFrame([], schema)
    near: dict[int, list[int]] = {}
    for a, b in _neighbours(sites, True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    pad = max(float(np.ptp(sites, axis=0).max()), 1.0) * margin
    (x0, y0), (x1, y1) = sites.min(axis=0) - pad, sites.max(axis=0) + pad
    cells = []
    for s, p in enumerate(sites):
        poly = [np.array(c) for c in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
        for o in near.get(s, []):
            normal, mid = sites[o] - p, (sites[o] + p) / 2
            kept = []
            for u, v in zip(poly, poly[1:] + poly[:1]):
                a, b = float((u - mid) @ normal), float((v - mid) @ normal)
                if a <= 0:
                    kept.append(u)
                if (a < 0 < b) or (b < 0 < a):
                    kept.append(u + (v - u) * (a / (a - b)))
            poly = kept
        cells.append([(float(u[0]), float(u[1])) for u in poly])
    return points.sparkSession.createDataFrame([(i, [cells[s]]) for i, s in zip(ids, place.tolist())], schema)


def _overlaps(p: np.ndarray, r: np.ndarray):
    """Index pairs of circles that may overlap, each once, in parts: circles are ranked by size in powers of two and meet the smaller ones by cells as wide as themselves."""
    top = max(float(r.max()), 1e-300)
    level = np.clip(np.floor(np.log2(top / np.maximum(r, top * 2.0**-20))), 0, 20).astype(int)
    for l in np.unique(level):
        small, big = np.flatnonzero(level >= l), np.flatnonzero(level == l)
        cell = np.floor((p - p.min(axis=0)) / (2 * top / 2.0**l)).astype(np.int64) + 1
        wide = int(cell[:, 1].max()) + 2
        code = cell[:, 0] * wide + cell[:, 1]
        small = small[np.argsort(code[small], kind="stable")]
        have = code[small]
        for step in (a * wide + b for a in (-1, 0, 1) for b in (-1, 0, 1)):
            low, high = (np.searchsorted(have, code[big] + step, side) for side in ("left", "right"))
            n = high - low
            i, j = np.repeat(big, n), small[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            once = (level[j] > l) | (i < j)
            yield i[once], j[once]


def circle_cartogram(points: DataFrame, key: str, size: str, x: str = "x", y: str = "y", share: float = 0.4, rounds: int = 500) -> DataFrame:
    """(key, x, y, radius): circles of area in proportion to `size` (all together `share` of the box), pushed apart where they overlap and pulled back to their places."""
    ids, m = _collect(points.where(F.col(size) >= 0), key, [x, y, size], None)
    t = points.schema[key].dataType.simpleString()
    schema = f"{key} {t}, x double, y double, radius double"
    if not ids:
        return points.sparkSession.createDataFrame([], schema)
    home, total = m[:, :2], max(m[:, 2].sum(), 1e-300)
    wide = np.maximum(np.ptp(home, axis=0), 1e-9)
    r = np.sqrt(m[:, 2] / total * share * wide[0] * wide[1] / np.pi)
    turn = np.arange(len(ids)) * 2.399963229728653
    p = home + 1e-9 * wide * np.column_stack([np.cos(turn), np.sin(turn)])
    for step in range(rounds):
        push = np.zeros_like(p)
        for i, j in _overlaps(p, r):
            d = p[i] - p[j]
            gap = np.sqrt((d * d).sum(axis=1))
            over = np.maximum(r[i] + r[j] - gap, 0)
            f = d * (over / np.maximum(gap, 1e-12) / 2)[:, None]
            for c in range(2):
                push[:, c] += np.bincount(i, f[:, c], len(p)) - np.bincount(j, f[:, c], len(p))
        pull = (home - p) * (0.05 * (1 - step / rounds))
        p = p + push * 0.5 + pull
        if np.abs(push).max() < 1e-9 * wide.max() and step > rounds // 2:
            break
    return points.sparkSession.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b), c in zip(ids, p, r)], schema)
