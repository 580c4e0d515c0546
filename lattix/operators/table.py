"""Table operators: merge, aggregate, select, sort, time groups, grids, duplicates, point-in-polygon joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def first_of_key(df: DataFrame, key: str, row: str) -> DataFrame:
    """One row a key: the one of least `row`."""
    cols = [c for c in df.columns]
    return df.groupBy(_key(key).alias("__k")).agg(F.min_by(F.struct(*cols), F.col(row)).alias("r")).select("__k", "r.*")


def merge_left(left: DataFrame, right: DataFrame, left_key: str, right_key: str, row: str, suffix: str = "_right") -> DataFrame:
    """Left join on trimmed string keys; of several right rows of a key the first (least `row`) is taken; clashing names get the suffix."""
    r = first_of_key(right, right_key, row)
    taken = {c.lower() for c in left.columns}
    r = r.select("__k", *[F.col(c).alias(c + suffix if c.lower() in taken else c) for c in right.columns if c != right_key])
    return left.withColumn("__k", _key(left_key)).join(r, "__k", "left").drop("__k")


def merge_outer(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer join on trimmed string keys; the key column is the left one, or the right where there is none."""
    keep = [c for c in right.columns if c != right_key and c not in left.columns]
    r = right.select(_key(right_key).alias("__rk"), *keep)
    out = left.withColumn("__k", _key(left_key)).join(r, F.col("__k") == F.col("__rk"), "full")
    return out.withColumn("key", F.coalesce("__k", "__rk")).drop("__k", "__rk")


def merge_by_order(left: DataFrame, right: DataFrame, left_order: str, right_order: str, suffix: str = "_right") -> DataFrame:
    """Left join of the i-th row with the i-th row, by each table's order column; right must have as many rows or more."""
    from lattix.functions.scalars import scalars, with_rank

    if scalars(right, n=F.count("*"))["n"] < scalars(left, n=F.count("*"))["n"]:
        raise ValueError("the right table has fewer rows than the left one")
    taken = {c.lower() for c in left.columns}
    a = with_rank(left, [F.col(left_order)], "__place")
    b = with_rank(right, [F.col(right_order)], "__place").select("__place", *[F.col(c).alias(c + suffix if c.lower() in taken else c) for c in right.columns])
    return a.join(b, "__place", "left").drop("__place")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def aggregate(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Row count and sum, mean, max and min of the columns by one key; undefined values are skipped."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max), ("min", F.min))]
    return df.groupBy(key).agg(F.count("*").alias("agg_count"), *aggs)


def dissolve(polys: DataFrame, key: str, group: str, rings: str = "rings", *columns: str) -> DataFrame:
    """aggregate() by group plus the outline: border segments that occur once among a group's edge-matched polygons."""
    nxt = F.transform(rings, lambda ring: F.transform(ring, lambda v, i: F.struct(v.alias("a"), F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1).alias("b"))))
    seg = polys.select(group, F.explode(F.flatten(nxt)).alias("s")).select(group, F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b")).where("a <> b")
    border = seg.groupBy(group, "a", "b").count().where("count = 1").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("outline"))
    return aggregate(polys, group, *columns).join(border, group, "left")


def select_range(df: DataFrame, column: str, low: float, high: float, selected: str = "selected", how: str = "new") -> DataFrame:
    """Marks rows with low <= column <= high; how: new, subset of, or append to an earlier selection.  Undefined is never selected."""
    hit = F.coalesce(F.col(column).between(low, high), F.lit(False))
    if how == "subset":
        hit = hit & F.col(selected)
    elif how == "append":
        hit = hit | F.col(selected)
    return df.withColumn(selected, hit)


def select_undefined(df: DataFrame, *columns: str, selected: str = "selected") -> DataFrame:
    """Marks rows with an undefined value in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).isNull()
    return df.withColumn(selected, hit)


def select_random(df: DataFrame, key: str, n: int, seed: int = 123456789, selected: str = "selected") -> DataFrame:
    """Marks n rows (all, if fewer), each set equally likely; depends on seed and key alone."""
    from lattix.functions.scalars import with_rank

    return with_rank(df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))), [F.col("__h"), F.col(key)], "__r").withColumn(selected, F.col("__r") <= n).drop("__h", "__r")


def clear(df: DataFrame, selected: str = "selected") -> DataFrame:
    return df.withColumn(selected, F.lit(False))


def invert(df: DataFrame, selected: str = "selected") -> DataFrame:
    return df.withColumn(selected, ~F.col(selected))


def add_neighbours(df: DataFrame, key: str, w: DataFrame, selected: str = "selected") -> DataFrame:
    """Adds the neighbours of the selected rows to the selection."""
    near = w.join(df.where(selected).select(F.col(key).alias("src")), "src", "left_semi").select(F.col("dst").alias(key)).distinct().withColumn("__n", F.lit(True))
    return df.join(near, key, "left").withColumn(selected, F.col(selected) | F.coalesce("__n", F.lit(False))).drop("__n")


def save_selection(df: DataFrame, selected: str, name: str, inside, outside) -> DataFrame:
    return df.withColumn(name, F.when(F.col(selected), F.lit(inside)).otherwise(F.lit(outside)))


def sort(df: DataFrame, column: str, key: str, ascending: bool = True) -> DataFrame:
    """Ascending: undefined first; descending: undefined last; ties by key."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col(key))


def selected_first(df: DataFrame, selected: str, key: str) -> DataFrame:
    return df.orderBy(F.col(selected).desc(), F.col(key))


def group_time(long: DataFrame, key: str, t: str, value: str, periods: list) -> DataFrame:
    """Long (key, t, value) to one column a period; a missing period is undefined."""
    return long.groupBy(key).pivot(t, periods).agg(F.first(value))


def ungroup_time(wide: DataFrame, key: str, columns: list[str], t: str = "t", value: str = "value") -> DataFrame:
    return wide.unpivot([key], columns, t, value)


def grid(spark, rows: int, cols: int, x0: float = 0.0, y0: float = 0.0, x1: float = 1.0, y1: float = 1.0) -> DataFrame:
    """(cell, row, col, rings): regular lattice polygons over the box, row by row from below."""
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    g = spark.range(rows * cols).select(F.col("id").alias("cell"), F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    corner = lambda dx, dy: F.struct((F.lit(x0) + (F.col("col") + dx) * w).alias("x"), (F.lit(y0) + (F.col("row") + dy) * h).alias("y"))
    return g.withColumn("rings", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))


def duplicates(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, x, y, copies, first) of points that share their place."""
    g = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")
    return points.select(key, x, y).join(g, [x, y])


def ring_area(ring: Column | str) -> Column:
    """Signed shoelace area of an array of struct<x,y>."""
    return F.aggregate(F.transform(ring, lambda v, i: v["x"] * F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)["y"] - F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)["x"] * v["y"]), F.lit(0.0), lambda a, b: a + b) / 2


def ring_length(ring: Column | str) -> Column:
    nxt = lambda i: F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)
    return F.aggregate(F.transform(ring, lambda v, i: F.hypot(v["x"] - nxt(i)["x"], v["y"] - nxt(i)["y"])), F.lit(0.0), lambda a, b: a + b)


def mean_centre(ring: Column | str) -> Column:
    n = F.size(ring)
    return F.struct((F.aggregate(ring, F.lit(0.0), lambda a, v: a + v["x"]) / n).alias("x"), (F.aggregate(ring, F.lit(0.0), lambda a, v: a + v["y"]) / n).alias("y"))


def inside(x: Column, y: Column, rings: Column | str) -> Column:
    """Even-odd crossing rule over all rings (holes included)."""

    def crossings(ring: Column) -> Column:
        def edge(v, i):
            u = F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)
            over = (v["y"] > y) != (u["y"] > y)
            return F.when(over & (x < (u["x"] - v["x"]) * (y - v["y"]) / F.nullif(u["y"] - v["y"], F.lit(0.0)) + v["x"]), 1).otherwise(0)

        return F.aggregate(F.transform(ring, edge), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1


def points_in_polygons(points: DataFrame, polys: DataFrame, point_key: str, poly_key: str, cell: float, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """(point, polygon) pairs: polygons are dealt to the grid cells their box covers, points to theirs; the crossing rule decides."""
    flat = F.flatten(rings)
    lo = lambda c: F.floor(F.array_min(F.transform(flat, lambda v: v[c])) / cell)
    hi = lambda c: F.floor(F.array_max(F.transform(flat, lambda v: v[c])) / cell)
    p = polys.select(F.col(poly_key).alias("polygon"), F.col(rings).alias("rings"), F.explode(F.sequence(lo("x"), hi("x"))).alias("cx"), lo("y").alias("y0"), hi("y").alias("y1"))
    p = p.select("polygon", "rings", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    q = points.select(F.col(point_key).alias("point"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    q = q.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return q.join(p, ["cx", "cy"]).where(inside(F.col("x"), F.col("y"), "rings")).select("point", "polygon", "x", "y")


def count_points(points: DataFrame, polys: DataFrame, point_key: str, poly_key: str, cell: float, value: str | None = None, **names) -> DataFrame:
    """Per polygon: points inside and, for a value, its sum, mean, median and population sd (0 where empty)."""
    hits = points_in_polygons(points, polys, point_key, poly_key, cell, **names)
    aggs = [F.count("*").alias("n_points")]
    if value:
        hits = hits.join(points.select(F.col(point_key).alias("point"), F.col(value).cast("double").alias("v")), "point")
        aggs += [F.sum("v").alias("v_sum"), F.avg("v").alias("v_mean"), F.median("v").alias("v_median"), F.stddev_pop("v").alias("v_sd")]
    out = polys.select(F.col(poly_key).alias("polygon")).join(hits.groupBy("polygon").agg(*aggs), "polygon", "left")
    return out.fillna(0)


def assign_polygon(points: DataFrame, polys: DataFrame, point_key: str, poly_key: str, cell: float, **names) -> DataFrame:
    """(point, polygon): the polygon a point lies in (the largest id of several), -1 where none."""
    hits = points_in_polygons(points, polys, point_key, poly_key, cell, **names).groupBy("point").agg(F.max("polygon").alias("polygon"))
    return points.select(F.col(point_key).alias("point")).join(hits, "point", "left").select("point", F.coalesce("polygon", F.lit(-1)).alias("polygon"))


def points_from_table(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with x and y as a point layer: numeric coordinates; rows without both are left out."""
    p = df.withColumn("x", F.col(x).try_cast("double")).withColumn("y", F.col(y).try_cast("double"))
    return p.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def double_counted(counts: DataFrame, features: DataFrame, count: str = "count") -> bool:
    """Whether a spatial count counted some feature more than once: the counts' sum is above the number of features."""
    from lattix.functions.scalars import scalars

    return (scalars(counts, s=F.sum(count))["s"] or 0) > scalars(features, n=F.count("*"))["n"]


def centroids(polys: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, area, x, y): area centroid of polygons; rings wind against each other where they are holes.  No area: undefined."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(ring):
        def add(s, i):
            v, w = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)
            c = v["x"] * w["y"] - w["x"] * v["y"]
            return F.struct((s["a"] + c).alias("a"), (s["x"] + (v["x"] + w["x"]) * c).alias("x"), (s["y"] + (v["y"] + w["y"]) * c).alias("y"))

        return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), zero, add)

    parts = F.transform(F.filter(rings, lambda r: F.size(r) > 0), step)
    s = F.aggregate(parts, zero, lambda a, b: F.struct((a["a"] + b["a"]).alias("a"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    out = polys.select(key, s.alias("s"))
    whole = F.nullif(F.col("s.a") * 3, F.lit(0.0))
    return out.select(key, (F.abs("s.a") / 2).alias("area"), (F.col("s.x") / whole).alias("x"), (F.col("s.y") / whole).alias("y"))
