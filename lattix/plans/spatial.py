"""Queries over weights and spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import autocorr, weights
from lattix.plans.tables import HAZEN, W, nation_block, rounded, supplier
from lattix.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def cells(spark, d):
    return read_table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("gx"), F.floor(F.col("p_partkey") / 50).alias("gy"), "p_retailprice", "p_size")


def places(spark, d):
    return supplier(spark, d).select("s_suppkey", (F.col("s_acctbal") / 500).alias("x"), F.col("s_nationkey").cast("double").alias("y"), "s_acctbal")


CELLS = "c AS (SELECT p_partkey, p_partkey % 50 AS gx, p_partkey // 50 AS gy, p_retailprice, p_size FROM part)"
ROOK = f"{CELLS}, w AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM c a JOIN c b ON (a.gx = b.gx AND b.gy IN (a.gy - 1, a.gy + 1)) OR (a.gy = b.gy AND b.gx IN (a.gx - 1, a.gx + 1)))"
PLACES = "p AS (SELECT s_suppkey, s_acctbal / 500 AS x, CAST(s_nationkey AS DOUBLE) AS y, s_acctbal FROM supplier)"
PAIRS = f"{PLACES}, d AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.s_suppkey <> b.s_suppkey)"
NEAR = f"{PAIRS}, k AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM d)"
Z = "z AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z FROM supplier WHERE s_suppkey IN (SELECT src FROM w))"
LAG = f"{W}, {Z}, l AS (SELECT a.s_suppkey, any_value(a.z) AS z, avg(b.z) AS lag, avg(b.z * b.z) AS lag2, median(b.z) AS med FROM z a JOIN w ON src = a.s_suppkey JOIN z b ON dst = b.s_suppkey GROUP BY 1)"


@register("block_weights", f"WITH {W} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM w")
def block_weights(spark, d):
    return nation_block(spark, d)


@register("rook_weights", f"WITH {ROOK} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM w")
def rook_weights(spark, d):
    return weights.lattice_weights(cells(spark, d), "p_partkey")


@register("queen_weights", f"WITH {CELLS} SELECT a.p_partkey AS src, b.p_partkey AS dst, CAST(1 AS DOUBLE) AS weight FROM c a JOIN c b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.p_partkey <> b.p_partkey")
def queen_weights(spark, d):
    return weights.lattice_weights(cells(spark, d), "p_partkey", queen=True)


@register("polygon_rook", """
SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, CAST(1 AS DOUBLE) AS weight FROM range(48) s(a), range(48) t(b) WHERE abs(a % 8 - b % 8) + abs(a // 8 - b // 8) = 1""")
def polygon_rook(spark, d):
    from lattix.operators.table import grid

    return weights.polygon_contiguity(grid(spark, 6, 8, 0, 0, 8, 6), "cell", queen=False)


@register("polygon_queen", """
SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, CAST(1 AS DOUBLE) AS weight FROM range(48) s(a), range(48) t(b) WHERE greatest(abs(a % 8 - b % 8), abs(a // 8 - b // 8)) = 1""")
def polygon_queen(spark, d):
    from lattix.operators.table import grid

    return weights.polygon_contiguity(grid(spark, 6, 8, 0, 0, 8, 6), "cell")


@register("second_order", f"WITH {CELLS} SELECT a.p_partkey AS src, b.p_partkey AS dst, CAST(1 AS DOUBLE) AS weight FROM c a JOIN c b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 2 WHERE EXISTS (SELECT 1 FROM c m WHERE abs(a.gx - m.gx) + abs(a.gy - m.gy) = 1 AND abs(b.gx - m.gx) + abs(b.gy - m.gy) = 1)")
def second_order(spark, d):
    return weights.higher_order(weights.lattice_weights(cells(spark, d), "p_partkey"), 2)


@register("distance_band", f"WITH {PAIRS} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM d WHERE d <= 2.5")
def distance_band(spark, d):
    return weights.distance_band(places(spark, d), "s_suppkey", 2.5)


@register("inverse_distance", f"WITH {PAIRS} SELECT src, dst, round(CASE WHEN d > 0 THEN 1 / d END, 6) AS weight FROM d WHERE d <= 2.5")
def inverse_distance(spark, d):
    return rounded(weights.distance_band(places(spark, d), "s_suppkey", 2.5, power=-1), "weight")


@register("arc_distance_band", """
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 360) - 180.0 AS x, (s_suppkey * 17 % 170) - 85.0 AS y FROM supplier), d AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, power(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2) AS h FROM p a JOIN p b ON a.s_suppkey <> b.s_suppkey)
SELECT src, dst, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS d FROM d WHERE 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) <= 1500""")
def arc_distance_band(spark, d):
    p = supplier(spark, d).select("s_suppkey", ((F.col("s_suppkey") * 37 % 360) - 180.0).alias("x"), ((F.col("s_suppkey") * 17 % 170) - 85.0).alias("y"))
    return rounded(weights.pairs_within(p, "s_suppkey", 1500, kind="arc"), "d", places=3)


@register("nearest_neighbours", f"WITH {NEAR} SELECT src, dst, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4")
def nearest_neighbours(spark, d):
    return rounded(weights.nearest(places(spark, d), "s_suppkey", 4), "d")


@register("kernel_weights", f"""
WITH {NEAR}, n AS (SELECT * FROM k WHERE rank <= 5), h AS (SELECT src, max(d) AS h FROM n GROUP BY 1)
SELECT src, dst, round(0.75 * (1 - (d / h) ** 2), 6) AS weight FROM n JOIN h USING (src) UNION ALL SELECT DISTINCT src, src, CAST(1 AS DOUBLE) FROM n""")
def kernel_weights(spark, d):
    return rounded(weights.kernel_weights(weights.nearest(places(spark, d), "s_suppkey", 5), "epanechnikov", adaptive=True), "weight")


@register("min_threshold", f"WITH {NEAR} SELECT round(max(d), 6) AS threshold FROM k WHERE rank = 1")
def min_threshold(spark, d):
    return rounded(weights.nearest(places(spark, d), "s_suppkey", 1).agg(F.max("d").alias("threshold")), "threshold")


@register("weights_union", f"WITH {PAIRS}, {W} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT src, dst FROM w UNION SELECT src, dst FROM d WHERE d <= 1.5)")
def weights_union(spark, d):
    return weights.union(nation_block(spark, d), weights.distance_band(places(spark, d), "s_suppkey", 1.5))


@register("weights_intersection", f"WITH {PAIRS}, {W} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT src, dst FROM w INTERSECT SELECT src, dst FROM d WHERE d <= 1.5)")
def weights_intersection(spark, d):
    return weights.intersection(nation_block(spark, d), weights.distance_band(places(spark, d), "s_suppkey", 1.5))


@register("row_standardized", f"WITH {W} SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 9) AS weight FROM w")
def row_standardized(spark, d):
    return rounded(weights.row_standardize(nation_block(spark, d)), "weight", places=9)


@register("weights_properties", f"""
WITH {PAIRS}, n AS (SELECT s_suppkey, count(dst) AS n FROM supplier LEFT JOIN d ON src = s_suppkey AND d <= 1.5 GROUP BY 1)
SELECT count(*) AS n_obs, CAST(sum(n) AS BIGINT) AS n_edges, min(n) AS min_nbrs, max(n) AS max_nbrs, round(avg(n), 6) AS mean_nbrs, median(n) AS median_nbrs, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS isolate_share, round(sum(n) * 100.0 / (count(*) * count(*)), 6) AS density FROM n""")
def weights_properties(spark, d):
    return rounded(weights.properties(supplier(spark, d), "s_suppkey", weights.distance_band(places(spark, d), "s_suppkey", 1.5)), "mean_nbrs", "isolate_share", "density")


@register("isolates", f"WITH {PAIRS} SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM d WHERE d <= 1.0)")
def isolates(spark, d):
    return weights.isolates(supplier(spark, d), "s_suppkey", weights.distance_band(places(spark, d), "s_suppkey", 1.0))


@register("connectivity_histogram", f"WITH {ROOK}, n AS (SELECT c.p_partkey, count(dst) AS n FROM c LEFT JOIN w ON src = c.p_partkey GROUP BY 1) SELECT n, count(*) AS cells FROM n GROUP BY 1")
def connectivity_histogram(spark, d):
    c = cells(spark, d)
    return weights.neighbour_counts(c, "p_partkey", weights.lattice_weights(c, "p_partkey")).groupBy("n").agg(F.count("*").alias("cells"))


@register("connected_components", """
SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1""")
def connected_components(spark, d):
    from lattix.operators.graph import connected_components as run

    return run(nation_block(spark, d))


@register("spacetime_weights", f"WITH {W} SELECT src, dst, t, CAST(1 AS DOUBLE) AS weight FROM w, (SELECT DISTINCT year(o_orderdate) AS t FROM orders)")
def spacetime_weights(spark, d):
    t = read_table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("t"))
    return weights.spacetime(nation_block(spark, d), t)


@register("spatial_lag", f"""
WITH {W}, o AS (SELECT src, dst FROM w UNION ALL SELECT s_suppkey, s_suppkey FROM supplier)
SELECT s_suppkey, round((SELECT avg(n.s_acctbal) FROM w JOIN supplier n ON n.s_suppkey = dst WHERE src = s.s_suppkey), 6) AS lag, round((SELECT median(n.s_acctbal) FROM w JOIN supplier n ON n.s_suppkey = dst WHERE src = s.s_suppkey), 6) AS middle, round((SELECT sum(n.s_acctbal) FROM o JOIN supplier n ON n.s_suppkey = dst WHERE src = s.s_suppkey), 6) AS total FROM supplier s""")
def spatial_lag(spark, d):
    s, w = supplier(spark, d), nation_block(spark, d)
    a = weights.lag(s, "s_suppkey", "s_acctbal", w)
    b = weights.lag(s, "s_suppkey", "s_acctbal", w, "median").withColumnRenamed("lag", "middle")
    c = weights.lag(s, "s_suppkey", "s_acctbal", w, "sum", own=True).withColumnRenamed("lag", "total")
    return rounded(a.join(b, "s_suppkey").join(c, "s_suppkey"), "lag", "middle", "total")


@register("local_moran", f"""
WITH {LAG} SELECT s.s_suppkey, round(z, 6) AS z, round(lag, 6) AS lag, round(z * lag, 6) AS moran_i, CASE WHEN z IS NULL THEN 5 WHEN z < 0 AND lag < 0 THEN 2 WHEN z < 0 AND lag > 0 THEN 3 WHEN z > 0 AND lag < 0 THEN 4 ELSE 1 END AS quadrant FROM supplier s LEFT JOIN l USING (s_suppkey)""")
def local_moran(spark, d):
    return rounded(autocorr.local_moran(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d)), "z", "lag", "moran_i")


@register("local_moran_median", f"WITH {LAG} SELECT s_suppkey, round(med, 6) AS lag, round(z * med, 6) AS moran_i FROM l")
def local_moran_median(spark, d):
    out = autocorr.local_moran(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d), median=True).where("z is not null")
    return rounded(out.select("s_suppkey", "lag", "moran_i"), "lag", "moran_i")


@register("local_moran_bivariate", f"""
WITH {ROOK}, u AS (SELECT * FROM c WHERE p_partkey IN (SELECT src FROM w)), z AS (SELECT p_partkey, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS z, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS y FROM u)
SELECT a.p_partkey, round(any_value(a.z) * avg(b.y), 6) AS moran_i FROM z a JOIN w ON src = a.p_partkey JOIN z b ON dst = b.p_partkey GROUP BY 1""")
def local_moran_bivariate(spark, d):
    c = cells(spark, d)
    out = autocorr.local_moran(c, "p_partkey", "p_retailprice", weights.lattice_weights(c, "p_partkey"), y="p_size").where("z is not null")
    return rounded(out.select("p_partkey", "moran_i"), "moran_i")


@register("global_moran", f"WITH {LAG} SELECT count(*) AS n, round(regr_slope(lag, z), 6) AS moran_i FROM l")
def global_moran(spark, d):
    return rounded(autocorr.global_moran(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d)), "moran_i")


@register("local_geary", f"WITH {LAG} SELECT s_suppkey, round(z * z - 2 * z * lag + lag2, 6) AS geary_c FROM l")
def local_geary(spark, d):
    return rounded(autocorr.local_geary(supplier(spark, d), "s_suppkey", ["s_acctbal"], nation_block(spark, d)), "geary_c")


G = f"{W}, x AS (SELECT s_suppkey, s_acctbal AS v FROM supplier WHERE s_suppkey IN (SELECT src FROM w)), t AS (SELECT sum(v) AS s, count(*) AS n FROM x), l AS (SELECT a.s_suppkey, any_value(a.v) AS v, sum(b.v) AS nb, count(*) AS k FROM x a JOIN w ON src = a.s_suppkey JOIN x b ON dst = b.s_suppkey GROUP BY 1)"


@register("getis_ord_g", f"WITH {G} SELECT s_suppkey, round(nb / k / (s - v), 9) AS g FROM l, t")
def getis_ord_g(spark, d):
    return rounded(autocorr.getis_ord(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d)).select("s_suppkey", "g"), "g", places=9)


@register("getis_ord_gstar", f"WITH {G} SELECT s_suppkey, round((nb + v) / (k + 1) / s, 9) AS g FROM l, t")
def getis_ord_gstar(spark, d):
    return rounded(autocorr.getis_ord(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d), star=True).select("s_suppkey", "g"), "g", places=9)


JC = f"{W}, x AS (SELECT s_suppkey, CAST(s_acctbal > 4000 AS INTEGER) AS a, CAST(s_suppkey % 2 AS INTEGER) AS b FROM supplier WHERE s_suppkey IN (SELECT src FROM w))"


def _binary(spark, d):
    return supplier(spark, d).select("s_suppkey", (F.col("s_acctbal") > 4000).cast("int").alias("a"), (F.col("s_suppkey") % 2).cast("int").alias("b"))


@register("local_join_count", f"WITH {JC} SELECT m.s_suppkey, CAST(any_value(m.a) * sum(n.a) AS BIGINT) AS jc FROM x m JOIN w ON src = m.s_suppkey JOIN x n ON dst = n.s_suppkey GROUP BY 1")
def local_join_count(spark, d):
    return autocorr.join_count(_binary(spark, d), "s_suppkey", ["a"], nation_block(spark, d))


@register("join_count_co_location", f"WITH {JC} SELECT m.s_suppkey, CAST(any_value(m.a * m.b) * sum(n.a * n.b) AS BIGINT) AS jc FROM x m JOIN w ON src = m.s_suppkey JOIN x n ON dst = n.s_suppkey GROUP BY 1")
def join_count_co_location(spark, d):
    return autocorr.join_count(_binary(spark, d), "s_suppkey", ["a", "b"], nation_block(spark, d))


@register("join_count_bivariate", f"WITH {JC} SELECT m.s_suppkey, CAST(any_value(m.a) * sum(n.b) AS BIGINT) AS jc FROM x m JOIN w ON src = m.s_suppkey JOIN x n ON dst = n.s_suppkey GROUP BY 1")
def join_count_bivariate(spark, d):
    return autocorr.join_count(_binary(spark, d), "s_suppkey", ["a", "b"], nation_block(spark, d), co_location=False)


@register("neighbour_match", f"""
WITH {NEAR}, v AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_nationkey - b.s_nationkey) + abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS rank FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey)
SELECT s_suppkey, CAST((SELECT count(*) FROM k JOIN v USING (src, dst) WHERE k.rank <= 4 AND v.rank <= 4 AND src = s_suppkey) AS INTEGER) AS shared FROM supplier""")
def neighbour_match(spark, d):
    p = places(spark, d)
    other = supplier(spark, d).select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    out = autocorr.neighbour_match(weights.nearest(p, "s_suppkey", 4), weights.nearest(other, "s_suppkey", 4, kind="manhattan"), p, "s_suppkey", 4)
    return out.select("s_suppkey", "shared")


@register("correlogram", f"""
WITH {PAIRS}, z AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS z FROM supplier)
SELECT CAST(least(floor(d / 1.0), 3) AS INTEGER) AS bin, count(*) AS pairs, round(avg(a.z * b.z), 6) AS autocorrelation FROM d JOIN z a ON src = a.s_suppkey JOIN z b ON dst = b.s_suppkey WHERE src < dst AND d <= 4.0 GROUP BY 1""")
def correlogram(spark, d):
    return rounded(autocorr.correlogram(places(spark, d), "s_suppkey", "s_acctbal", 4.0, 4), "autocorrelation")


@register("join_count_ratio", f"""
WITH {ROOK}, g AS (SELECT a.p_size % 4 AS cluster, count(*) AS neighbours, CAST(sum(CASE WHEN a.p_size % 4 = b.p_size % 4 THEN 1 ELSE 0 END) AS BIGINT) AS same FROM w JOIN c a ON src = a.p_partkey JOIN c b ON dst = b.p_partkey GROUP BY 1)
SELECT g.cluster, n, neighbours, same, round(same / neighbours, 6) AS ratio FROM g JOIN (SELECT p_size % 4 AS cluster, count(*) AS n FROM part GROUP BY 1) USING (cluster)""")
def join_count_ratio(spark, d):
    c = cells(spark, d).withColumn("cluster", F.col("p_size") % 4)
    return rounded(autocorr.join_count_ratio(c, "p_partkey", "cluster", weights.lattice_weights(c, "p_partkey")), "ratio")


@register("quantile_lisa", f"""
WITH {HAZEN.format(at='(75.0)')}, {W}, x AS (SELECT s_suppkey, CAST(s_acctbal > (SELECT br FROM b) AS INTEGER) AS a FROM supplier WHERE s_suppkey IN (SELECT src FROM w))
SELECT m.s_suppkey, CAST(any_value(m.a) * sum(n.a) AS BIGINT) AS jc FROM x m JOIN w ON src = m.s_suppkey JOIN x n ON dst = n.s_suppkey GROUP BY 1""")
def quantile_lisa(spark, d):
    return autocorr.quantile_lisa(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d), 4, 4)


@register("local_moran_permutation")
def local_moran_permutation(spark, d):
    return autocorr.permute(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d), 999)


@register("local_geary_permutation")
def local_geary_permutation(spark, d):
    return autocorr.permute(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d), statistic="geary")


@register("getis_ord_permutation")
def getis_ord_permutation(spark, d):
    return autocorr.permute(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d), statistic="g")


@register("multivariate_geary_permutation")
def multivariate_geary_permutation(spark, d):
    s = supplier(spark, d).withColumn("k", F.col("s_suppkey") % 5)
    return autocorr.permute(s, "s_suppkey", ["s_acctbal", "k"], nation_block(spark, d), statistic="geary")


@register("join_count_permutation")
def join_count_permutation(spark, d):
    return autocorr.permute(_binary(spark, d), "s_suppkey", "a", nation_block(spark, d), statistic="join_count")


@register("global_moran_permutation")
def global_moran_permutation(spark, d):
    return autocorr.permute_global(supplier(spark, d), "s_suppkey", "s_acctbal", nation_block(spark, d))


MANY = "m AS (SELECT p_partkey AS id, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part), d AS (SELECT a.id AS src, b.id AS dst, sqrt((a.a - b.a) ** 2 + (a.b - b.b) ** 2) AS d FROM m a JOIN m b ON a.id <> b.id)"


@register("multivariate_band", f"WITH {MANY} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM d WHERE d <= 5.0")
def multivariate_band(spark, d):
    return weights.multivariate_band(read_table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], 5.0)


@register("multivariate_knn", f"WITH {MANY} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6) + 0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM d) WHERE rank <= 4")
def multivariate_knn(spark, d):
    return rounded(weights.multivariate_knn(read_table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], 4), "d").select("src", "dst", "rank", "d")


@register("multivariate_quantile_lisa", f"""
WITH {HAZEN.format(at='(50.0)')}, {W}, x AS (SELECT s_suppkey, CAST(s_acctbal > (SELECT br FROM b) AS INTEGER) AS a FROM supplier WHERE s_suppkey IN (SELECT src FROM w))
SELECT m.s_suppkey, CAST(any_value(m.a) * sum(n.a) AS BIGINT) AS jc FROM x m JOIN w ON src = m.s_suppkey JOIN x n ON dst = n.s_suppkey GROUP BY 1""")
def multivariate_quantile_lisa(spark, d):
    s = supplier(spark, d).withColumn("again", F.col("s_acctbal") * 2)
    return autocorr.multivariate_quantile_lisa(s, "s_suppkey", [("s_acctbal", 2, 2), ("again", 2, 2)], nation_block(spark, d))
