"""Spatial weights as edge DataFrames (src, dst, weight): construction, set algebra, properties, lag.

Every construction is an equi-join on a key (category, vertex, edge, grid cell), so
nothing compares all pairs.  An observation without edges is an isolate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.functions.scalars import ratio

EARTH_KM = 6371.0


def _edges(df: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select("src", "dst", w.alias("weight"))


def block_weights(obs: DataFrame, key: str, *categories: str) -> DataFrame:
    """Neighbours agree on every category; negative numeric categories and nulls have none."""
    keep = obs.select(F.col(key).alias("src"), *categories)
    for c in categories:
        keep = keep.where(F.col(c).isNotNull())
        if keep.schema[c].dataType.typeName() in ("integer", "long", "double", "short", "float"):
            keep = keep.where(F.col(c) >= 0)
    other = keep.withColumnRenamed("src", "dst")
    return _edges(keep.join(other, list(categories)).where("src <> dst"))


def lattice_weights(cells: DataFrame, key: str, x: str = "gx", y: str = "gy", queen: bool = False) -> DataFrame:
    """Contiguity on integer cell coordinates: each cell asks for its 4 or 8 neighbouring cells."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (queen or not (dx and dy))]
    ask = cells.select(F.col(key).alias("src"), F.explode(F.array(*[F.struct((F.col(x) + dx).alias("nx"), (F.col(y) + dy).alias("ny")) for dx, dy in steps])).alias("n")).select("src", "n.*")
    have = cells.select(F.col(key).alias("dst"), F.col(x).alias("nx"), F.col(y).alias("ny"))
    return _edges(ask.join(have, ["nx", "ny"]).where("src <> dst"))


def polygon_contiguity(polys: DataFrame, key: str, rings: str = "rings", queen: bool = True, precision: float = 0.0) -> DataFrame:
    """Rook: a shared border segment; queen: a shared vertex.  rings: array of rings of struct<x,y>, closed or not.

    Vertices are snapped to a grid of `precision` (0: exact values) and joined by equality.
    """
    snap = (lambda c: F.round(c / precision)) if precision else (lambda c: c)
    p = polys.select(F.col(key).alias("id"), F.explode(rings).alias("ring"))
    if queen:
        parts = p.select("id", F.explode("ring").alias("v")).select("id", snap(F.col("v.x")).alias("a"), snap(F.col("v.y")).alias("b")).distinct()
        keys = ["a", "b"]
    else:
        nxt = F.transform("ring", lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.element_at("ring", F.pmod(i + 1, F.size("ring")) + 1)["x"].alias("x2"), F.element_at("ring", F.pmod(i + 1, F.size("ring")) + 1)["y"].alias("y2")))
        e = p.select("id", F.explode(nxt).alias("s")).select("id", *[snap(F.col(f"s.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])
        e = e.where("x1 <> x2 or y1 <> y2")
        flip = F.struct("x1", "y1") > F.struct("x2", "y2")
        keys = ["a", "b", "c", "d"]
        ends = zip(keys, ("x1", "y1", "x2", "y2"), ("x2", "y2", "x1", "y1"))
        parts = e.select("id", *[F.when(flip, F.col(r)).otherwise(F.col(f)).alias(k) for k, f, r in ends]).distinct()
    return _edges(parts.withColumnRenamed("id", "src").join(parts.withColumnRenamed("id", "dst"), keys).where("src <> dst").select("src", "dst").distinct())


def distance(kind: str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """euclidean, manhattan, or arc (great circle in km; x is longitude, y latitude, in degrees)."""
    if kind == "manhattan":
        return F.abs(x1 - x2) + F.abs(y1 - y2)
    if kind == "arc":
        la, lb = F.radians(y1), F.radians(y2)
        h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
        return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def pairs_within(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y", kind: str = "euclidean", asked: DataFrame | None = None) -> DataFrame:
    """(src, dst, d) with d <= radius: points meet by grid cells of the radius, then the distance decides; asked: (id) of the sources.

    Arc distances are bounded by cells on the unit sphere (chord length), so poles and the date line are no exception.
    """
    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    if kind == "arc":
        lon, lat, size = F.radians("x"), F.radians("y"), 2 * math.sin(min(radius / EARTH_KM, math.pi) / 2) + 1e-12
        axes = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
    else:
        size, axes = radius, [F.col("x"), F.col("y")]
    size = size if size > 0 else 1.0
    cell = p.withColumn("cell", F.array(*[F.floor(a / size) for a in axes]))
    steps = [[]]
    for _ in axes:
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    near = F.array(*[F.array(*[F.col("cell")[i] + d for i, d in enumerate(s)]) for s in steps])
    a = (cell if asked is None else cell.join(asked, "id", "left_semi")).select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(near).alias("cell"))
    b = cell.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cell")
    d = distance(kind, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return a.join(b, "cell").where("src <> dst").select("src", "dst", d.alias("d")).where(F.col("d") <= radius)


def distance_band(points: DataFrame, key: str, radius: float, power: float | None = None, **how) -> DataFrame:
    """weight 1, or d^power (inverse distance: -1; coincident points then have no defined weight)."""
    p = pairs_within(points, key, radius, **how)
    return _edges(p, F.lit(1.0) if power is None else F.when((F.col("d") > 0) | F.lit(power >= 0), F.pow("d", F.lit(float(power)))))


def nearest(points: DataFrame, key: str, k: int, x: str = "x", y: str = "y", kind: str = "euclidean", start: float | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, d, rank): the k nearest of each point, ties to the smaller id.

    The search radius starts at one that holds about 3k points on average and doubles for the points that
    found fewer than k within it, so only those are asked again.
    """
    from lattix.functions.scalars import scalars
    from lattix.session import cut

    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    s = scalars(p, n=F.count("*"), x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"))
    n = s["n"]
    k = min(k, n - 1)
    if n < 2 or k < 1:
        return pairs_within(p, "id", 1.0).where("false").select("src", "dst", "d", F.lit(1).alias("rank"))
    wide, high = s["x1"] - s["x0"], s["y1"] - s["y0"]
    radius = start or max(math.sqrt(3 * k * max(wide, 1e-9) * max(high, 1e-9) / (math.pi * n)), 3 * k * max(wide, high) / (2 * n), 1e-9)
    reach = math.hypot(wide, high) if kind != "manhattan" else wide + high
    if kind == "arc":
        radius, reach = radius * 111.2, math.pi * EARTH_KM
    w = Window.partitionBy("src").orderBy("d", "dst")
    out, todo = None, p.select("id") if queries is None else queries.select(F.col(key).alias("id"))
    while True:
        near = pairs_within(p, "id", radius, kind=kind, asked=todo)
        ranked = cut(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        full = ranked.groupBy("src").count().where(F.col("count") >= k).select("src")
        got = ranked if radius >= reach else ranked.join(full, "src", "left_semi")
        out = got if out is None else out.unionByName(got)
        todo = cut(todo.join(full, F.col("id") == F.col("src"), "left_anti"))
        if radius >= reach or todo.isEmpty():
            return out.select("src", "dst", "d", "rank")
        radius = min(2 * radius, reach * 1.0000001)


def knn_weights(points: DataFrame, key: str, k: int, power: float | None = None, **how) -> DataFrame:
    return _edges(nearest(points, key, k, **how), F.lit(1.0) if power is None else F.pow("d", F.lit(float(power))))


def _many(obs: DataFrame, key: str, xs: list[str]) -> DataFrame:
    return obs.select(F.col(key).alias("id"), F.array(*[F.col(x).cast("double") for x in xs]).alias("v")).where(~F.exists("v", lambda c: c.isNull()))


def multivariate_pairs(obs: DataFrame, key: str, xs: list[str], radius: float, kind: str = "euclidean", asked: DataFrame | None = None) -> DataFrame:
    """(src, dst, d) with d <= radius over several variables (euclidean or manhattan); rows with an undefined one have no pairs.

    Rows meet by cells of the radius over the first three variables; the distance over all decides.
    """
    p, axes = _many(obs, key, xs), min(3, len(xs))
    size = radius if radius > 0 else 1.0
    cell = p.withColumn("cell", F.array(*[F.floor(F.col("v")[i] / size) for i in range(axes)]))
    steps = [[]]
    for _ in range(axes):
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    near = F.array(*[F.array(*[F.col("cell")[i] + d for i, d in enumerate(s)]) for s in steps])
    a = (cell if asked is None else cell.join(asked, "id", "left_semi")).select(F.col("id").alias("src"), F.col("v").alias("v1"), F.explode(near).alias("cell"))
    b = cell.select(F.col("id").alias("dst"), F.col("v").alias("v2"), "cell")
    gap = F.zip_with("v1", "v2", lambda s, t: F.abs(s - t) if kind == "manhattan" else (s - t) * (s - t))
    total = F.aggregate(gap, F.lit(0.0), lambda s, t: s + t)
    d = total if kind == "manhattan" else F.sqrt(total)
    return a.join(b, "cell").where("src <> dst").select("src", "dst", d.alias("d")).where(F.col("d") <= radius)


def multivariate_band(obs: DataFrame, key: str, xs: list[str], radius: float, kind: str = "euclidean") -> DataFrame:
    return _edges(multivariate_pairs(obs, key, xs, radius, kind))


def multivariate_knn(obs: DataFrame, key: str, xs: list[str], k: int, kind: str = "euclidean", start: float | None = None) -> DataFrame:
    """(src, dst, d, rank): the k nearest rows over several variables, ties to the smaller id; the radius doubles for rows that found fewer."""
    from lattix.functions.scalars import scalars
    from lattix.session import cut

    p = _many(obs, key, xs)
    flat = cut(p.select("id", *[F.col("v")[i].alias(f"v{i}") for i in range(len(xs))]))
    names = flat.columns[1:]
    s = scalars(flat, n=F.count("*"), **{f"lo{i}": F.min(c) for i, c in enumerate(names)}, **{f"hi{i}": F.max(c) for i, c in enumerate(names)})
    n = s["n"]
    k = min(k, n - 1)
    if n < 2 or k < 1:
        return multivariate_pairs(flat, "id", names, 1.0, kind).where("false").withColumn("rank", F.lit(1))
    wide = [s[f"hi{i}"] - s[f"lo{i}"] for i in range(len(names))]
    reach = sum(wide) if kind == "manhattan" else math.hypot(*wide)
    radius = start or max(max(wide) * (3 * k / n) ** (1 / len(names)) / 2, 1e-9)
    w = Window.partitionBy("src").orderBy("d", "dst")
    out, todo = None, flat.select("id")
    while True:
        ranked = cut(multivariate_pairs(flat, "id", names, radius, kind, todo).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        full = ranked.groupBy("src").count().where(F.col("count") >= k).select("src")
        got = ranked if radius >= reach else ranked.join(full, "src", "left_semi")
        out = got if out is None else out.unionByName(got)
        todo = cut(todo.join(full, F.col("id") == F.col("src"), "left_anti"))
        if radius >= reach or todo.isEmpty():
            return out
        radius = min(2 * radius, reach * 1.0000001)


KERNELS = {
    "uniform": lambda z: F.lit(0.5), "triangular": lambda z: 1 - z, "epanechnikov": lambda z: 0.75 * (1 - z * z),
    "quartic": lambda z: 15 / 16 * F.pow(1 - z * z, 2), "gaussian": lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi),
}


def kernel_weights(near: DataFrame, kernel: str, bandwidth: float | None = None, adaptive: bool = False, diagonal: bool = True) -> DataFrame:
    """Kernel of d / bandwidth for (src, dst, d) rows.  adaptive: each source's largest d; else `bandwidth` or the largest of
    all.  diagonal: self weights are 1, else the kernel at 0."""
    if adaptive:
        near = near.join(near.groupBy("src").agg(F.max("d").alias("h")), "src")
    else:
        near = near.withColumn("h", F.lit(float(bandwidth if bandwidth is not None else near.agg(F.max("d")).first()[0])))
    f = KERNELS[kernel]
    off = near.select("src", "dst", f(ratio(F.col("d"), F.col("h"))).alias("weight"))
    own = near.select("src").distinct().select("src", F.col("src").alias("dst"), (F.lit(1.0) if diagonal else f(F.lit(0.0))).alias("weight"))
    return off.unionByName(own)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _edges(a.select("src", "dst").unionByName(b.select("src", "dst")).distinct())


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _edges(a.select("src", "dst").intersect(b.select("src", "dst")))


def higher_order(w: DataFrame, order: int, lower: bool = False) -> DataFrame:
    """Neighbours `order` steps away and no nearer (lower: up to `order` steps)."""
    from lattix.session import cut

    step = w.select("src", "dst").distinct()
    seen = ring = step
    for _ in range(order - 1):
        far = ring.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).where("src <> dst").distinct()
        ring = cut(far.join(seen, ["src", "dst"], "left_anti"))
        seen = seen.unionByName(ring)
    return _edges(seen if lower else ring)


def row_standardize(w: DataFrame) -> DataFrame:
    sums = w.groupBy("src").agg(F.sum("weight").alias("total"))
    return w.join(sums, "src").select("src", "dst", ratio(F.col("weight"), F.col("total")).alias("weight"))


def twins(w: DataFrame, ids: list):
    """For every id the place of the first one that has the same neighbours, both counted among their own, at one weight throughout; others, and all where the weights are not symmetric, stand for themselves.

    Rows are compared by sums of 64-bit hashes in one grouped aggregate, so no edge leaves the executors."""
    import numpy as np
    import pandas as pd

    e = w.where("src <> dst").select("src", F.col("dst").cast(w.schema["src"].dataType).alias("dst"), F.col("weight").cast("double").alias("weight"))
    halves = lambda *c: (F.xxhash64(*c).bitwiseAND((1 << 32) - 1), F.shiftrightunsigned(F.xxhash64(*c), 32))
    sums = [F.sum(h).alias(f"{v}{i}") for v, c in (("own", ("dst", "weight")), ("out", ("src", "dst", "weight")), ("back", ("dst", "src", "weight"))) for i, h in enumerate(halves(*c))]
    t = e.groupBy("src").agg(*sums, F.count("*").alias("n"), F.count("weight").alias("known"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    t = t.select("*", *[(F.col(f"own{i}") + h).alias(f"all{i}") for i, h in enumerate(halves("src", "low"))]).toPandas()
    kind = np.arange(len(ids))
    if any(int(t[f"out{i}"].sum()) != int(t[f"back{i}"].sum()) for i in (0, 1)):
        return kind
    last = {v: i for i, v in enumerate(ids)}
    at = pd.Index(list(last)).get_indexer(t["src"])
    t["place"] = np.array([*last.values(), 0], int)[at]
    t = t[(at >= 0) & (t["low"] == t["high"]) & (t["known"] == t["n"])]
    kind[t["place"].to_numpy()] = t.groupby(["all0", "all1", "n", "low"])["place"].transform("min").to_numpy()
    return kind


def edges_of_kinds(w: DataFrame, ids: list, kind):
    """(a, b, weight): places of the edges that leave the first place of every kind."""
    import numpy as np
    import pandas as pd

    e = w.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    first = np.flatnonzero(kind == np.arange(len(ids)))
    if len(first) < len(ids):
        own = w.sparkSession.createDataFrame([(ids[i],) for i in first.tolist()], f"src {w.schema['src'].dataType.simpleString()}")
        e = e.join(F.broadcast(own), "src", "left_semi")
    last = {v: i for i, v in enumerate(ids)}
    t, names, place = e.toPandas(), pd.Index(list(last)), np.array(list(last.values()), int)
    a, b = (names.get_indexer(t[c]) for c in ("src", "dst"))
    known = (a >= 0) & (b >= 0)
    return place[a[known]], place[b[known]], t["weight"].to_numpy()[known]


def symmetric(w: DataFrame) -> bool:
    e = w.select("src", "dst", "weight")
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), ["src", "dst", "weight"], "left_anti").isEmpty()


def isolates(obs: DataFrame, key: str, w: DataFrame) -> DataFrame:
    return obs.select(key).join(w.where("src <> dst").select(F.col("src").alias(key)), key, "left_anti")


def neighbour_counts(obs: DataFrame, key: str, w: DataFrame) -> DataFrame:
    """(key, n): neighbours other than itself; 0 for isolates."""
    n = w.where("src <> dst").groupBy(F.col("src").alias(key)).agg(F.count("*").alias("n"))
    return obs.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def properties(obs: DataFrame, key: str, w: DataFrame) -> DataFrame:
    """One row: n, edges, min, max, mean, median neighbours, share of isolates, density in percent."""
    return neighbour_counts(obs, key, w).agg(
        F.count("*").alias("n_obs"), F.sum("n").alias("n_edges"), F.min("n").alias("min_nbrs"), F.max("n").alias("max_nbrs"), F.avg("n").alias("mean_nbrs"),
        F.median("n").alias("median_nbrs"), F.avg((F.col("n") == 0).cast("double")).alias("isolate_share"),
        (F.sum("n") * 100.0 / (F.count("*") * F.count("*"))).alias("density"),
    )


def spacetime(w: DataFrame, times: DataFrame, t: str = "t") -> DataFrame:
    """The same neighbours within every period; times: one row a period (a short list)."""
    return w.withColumn(t, F.explode(F.lit([r[0] for r in times.select(t).distinct().orderBy(t).collect()]))).select("src", "dst", t, "weight")


def lag(obs: DataFrame, key: str, value: str, w: DataFrame, how: str = "mean", own: bool = False) -> DataFrame:
    """(key, lag): neighbours' mean (binary), weighted (sum w x / sum w), sum (sum w x) or median.

    Undefined neighbours are skipped; self edges count only if own; isolates are undefined.
    """
    x = obs.select(F.col(key).alias("dst"), F.col(value).cast("double").alias("x")).where("x is not null")
    e = w if own else w.where("src <> dst")
    if own:
        e = e.select("src", "dst", "weight").unionByName(obs.select(F.col(key).alias("src"), F.col(key).alias("dst"), F.lit(1.0).alias("weight")).join(e.select("src", "dst"), ["src", "dst"], "left_anti"))
    agg = {"mean": F.avg("x"), "weighted": ratio(F.sum(F.col("weight") * F.col("x")), F.sum("weight")), "sum": F.sum(F.col("weight") * F.col("x")), "median": F.median("x")}[how]
    return obs.select(key).join(e.join(x, "dst").groupBy(F.col("src").alias(key)).agg(agg.alias("lag")), key, "left")
