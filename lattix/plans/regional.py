"""Queries over regions, density trees, shapes against shapes, and the pair and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import autocorr, classify, density, geometry, regions, regression, weights
from lattix.operators.table import grid, ring_area
from lattix.plans.spatial import PAIRS, PLACES, places
from lattix.plans.tables import RATE, W, nation_block, rate_supplier, rounded, supplier
from lattix.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CELL = "cell AS (SELECT CAST(i AS BIGINT) AS cell, i % 8 AS cx, i // 8 AS cy FROM range(48) t(i))"
LATTICE = "g AS (SELECT CAST(i AS BIGINT) AS id, i % 7 AS x, i // 7 AS y FROM range(35) t(i))"
STANDARD = "v AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS a, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER () AS b FROM supplier)"
XS = ["s_acctbal", "s_nationkey"]


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def cells(spark):
    return grid(spark, 6, 8, 0, 0, 8, 6)


def lattice(spark):
    return spark.range(35).select("id", (F.col("id") % 7).cast("double").alias("x"), F.floor(F.col("id") / 7).cast("double").alias("y"))


def around(spark, d):
    return geometry.voronoi_weights(places(spark, d), "s_suppkey")


def _numbers(spark, found: dict, *keep: str):
    return spark.createDataFrame([(k, None if found[k] is None else float(found[k])) for k in keep], "statistic string, value double")


@register("dbscan_star", f"""
WITH RECURSIVE {PAIRS}, n AS (SELECT src, dst FROM d WHERE d <= 1.0), core AS (SELECT s_suppkey AS id FROM supplier WHERE (SELECT count(*) FROM n WHERE src = s_suppkey) + 1 >= 3),
e AS (SELECT src, dst FROM n WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)), reach AS (SELECT id, id AS to_ FROM core UNION SELECT r.id, e.dst FROM reach r JOIN e ON r.to_ = e.src),
comp AS (SELECT id, min(to_) AS c FROM reach GROUP BY 1), num AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS k FROM comp GROUP BY c)
SELECT s_suppkey, CAST(coalesce(k, -1) AS INTEGER) AS cluster FROM supplier LEFT JOIN comp ON id = s_suppkey LEFT JOIN num USING (c)""")
def dbscan_star(spark, d):
    from lattix.operators.cluster import dbscan

    return dbscan(places(spark, d), "s_suppkey", 1.0, 3, borders=False).withColumn("cluster", F.col("cluster").cast("int"))


@register("hdbscan")
def hdbscan(spark, d):
    return density.hdbscan(supplier(spark, d), "s_suppkey", XS, least=5, min_points=3)


@register("hdbscan_leaf")
def hdbscan_leaf(spark, d):
    return density.hdbscan(supplier(spark, d), "s_suppkey", XS, least=5, min_points=3, select="leaf")


def _medoids(method: str, table: str, key: str, xs: list[str]):
    return lambda spark, d: density.kmedoids(read_table(spark, d, table), key, xs, 4, method)


QUERIES["kmedoids_pam"] = _medoids("pam", "supplier", "s_suppkey", XS)
QUERIES["kmedoids_clarans"] = _medoids("clarans", "supplier", "s_suppkey", XS)
QUERIES["kmedoids_clara"] = _medoids("clara", "part", "p_partkey", ["p_retailprice", "p_size"])
for _a in ("gaussian", "knn", "mutual"):
    QUERIES[f"spectral_{_a}"] = lambda spark, d, a=_a: density.spectral(supplier(spark, d), "s_suppkey", XS, 4, a)


@register("smacof")
def smacof(spark, d):
    return density.smacof(supplier(spark, d), "s_suppkey", XS)[0]


@register("tsne")
def tsne(spark, d):
    return density.tsne(supplier(spark, d), "s_suppkey", XS)


@register("distance_matrix", f"WITH {STANDARD} SELECT p.s_suppkey AS src, q.s_suppkey AS dst, round(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2), 6) AS d FROM v p JOIN v q ON p.s_suppkey <> q.s_suppkey")
def distance_matrix(spark, d):
    return rounded(density.distance_matrix(supplier(spark, d), "s_suppkey", XS), "d")


@register("spanning_tree")
def spanning_tree(spark, d):
    return density.spanning_weights(places(spark, d), "s_suppkey")


for _m in ("ward", "average", "complete", "single"):
    QUERIES[f"redcap_{_m}"] = lambda spark, d, m=_m: regions.redcap(places(spark, d), "s_suppkey", ["s_acctbal"], 5, around(spark, d), m)
for _m in ("greedy", "tabu", "annealing"):
    QUERIES[f"azp_{_m}"] = lambda spark, d, m=_m: regions.azp(places(spark, d), "s_suppkey", ["s_acctbal", "y"], 5, around(spark, d), m)
    QUERIES[f"max_p_{_m}"] = lambda spark, d, m=_m: regions.max_p(places(spark, d), "s_suppkey", ["s_acctbal", "y"], around(spark, d), None, 3, m)


@register("spatial_kmeans")
def spatial_kmeans(spark, d):
    return regions.spatial_kmeans(places(spark, d), "s_suppkey", ["s_acctbal", "y"], 4, around(spark, d))


@register("fragmentation", f"""
WITH RECURSIVE {PAIRS}, e AS (SELECT src, dst FROM d WHERE d <= 2.5 AND src % 4 = dst % 4), reach AS (SELECT s_suppkey AS id, s_suppkey AS to_ FROM supplier UNION SELECT r.id, e.dst FROM reach r JOIN e ON r.to_ = e.src),
comp AS (SELECT id, min(to_) AS c FROM reach GROUP BY 1), m AS (SELECT id % 4 AS cluster, c, count(*) AS m FROM comp GROUP BY 1, 2), s AS (SELECT *, m / sum(m) OVER (PARTITION BY cluster) AS p FROM m)
SELECT cluster, CAST(sum(m) AS BIGINT) AS n, count(*) AS parts, round(sum(-p * ln(p)), 6) + 0.0 AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy_std, round(sum(p * p), 6) AS simpson FROM s GROUP BY 1""")
def fragmentation(spark, d):
    p = places(spark, d).withColumn("cluster", F.col("s_suppkey") % 4)
    return rounded(regions.fragmentation(p, "s_suppkey", "cluster", weights.distance_band(p, "s_suppkey", 2.5)), "entropy", "entropy_std", "simpson")


@register("compactness", "SELECT CAST(c AS BIGINT) AS cluster, CAST(24 AS DOUBLE) AS area, CAST(20 AS DOUBLE) AS perimeter, round(4 * pi() * 24 / 400, 6) AS quotient FROM range(2) t(c)")
def compactness(spark, d):
    half = cells(spark).withColumn("half", F.floor(F.col("cell") % 8 / 4))
    return rounded(regions.compactness(half, "cell", "half"), "area", "perimeter", "quotient")


@register("cluster_diameter", "SELECT CAST(c AS BIGINT) AS cluster, CAST(24 AS BIGINT) AS n, CAST(8 AS INTEGER) AS steps FROM range(2) t(c)")
def cluster_diameter(spark, d):
    half = cells(spark).withColumn("half", F.floor(F.col("cell") % 8 / 4))
    return regions.diameter(half, "cell", "half", weights.polygon_contiguity(half, "cell", queen=False))


BOXES = f"{CELL}, box AS (SELECT CAST(i AS BIGINT) AS box, i % 4 AS bx, i // 4 AS by_ FROM range(12) t(i)), hit AS (SELECT cell, box FROM cell JOIN box ON cx + 1 >= 0.5 + 2 * bx AND cx <= 2.5 + 2 * bx AND cy + 1 >= 0.5 + 2 * by_ AND cy <= 2.5 + 2 * by_)"


@register("polygons_in_polygons", f"WITH {BOXES} SELECT box.box AS cell, count(hit.cell) AS n_shapes FROM box LEFT JOIN hit ON hit.box = box.box GROUP BY 1")
def polygons_in_polygons(spark, d):
    return geometry.count_shapes(cells(spark), grid(spark, 3, 4, 0.5, 0.5, 8.5, 6.5), "cell", "cell", 1.5)


@register("assign_polygons", f"WITH {BOXES} SELECT cell.cell, coalesce(max(box), -1) AS polygon FROM cell LEFT JOIN hit ON hit.cell = cell.cell GROUP BY 1")
def assign_polygons(spark, d):
    return geometry.assign_shapes(cells(spark), grid(spark, 3, 4, 0.5, 0.5, 8.5, 6.5), "cell", "cell", 1.5)


@register("lines_in_polygons", f"WITH {CELL} SELECT cell, CAST(CASE WHEN cx <= 3 THEN 1 ELSE 0 END AS BIGINT) AS n_shapes FROM cell")
def lines_in_polygons(spark, d):
    end = lambda x: F.struct(F.lit(x).alias("x"), (F.col("id") + 0.5).cast("double").alias("y"))
    lines = spark.range(6).select("id", F.array(end(0.25), end(1.7), end(3.6)).alias("path"))
    return geometry.count_shapes(lines, cells(spark), "id", "cell", 1.0, lines=True, a_shape="path")


@register("select_rectangle", f"WITH {PLACES} SELECT s_suppkey FROM p WHERE x BETWEEN 2 AND 12 AND y BETWEEN 3 AND 15")
def select_rectangle(spark, d):
    return geometry.select_rectangle(places(spark, d), 2, 15, 12, 3).select("s_suppkey")


@register("select_circle", f"WITH {PLACES} SELECT s_suppkey FROM p WHERE (x - 8) ** 2 + (y - 12) ** 2 <= 49")
def select_circle(spark, d):
    return geometry.select_circle(places(spark, d), 8, 12, 7).select("s_suppkey")


@register("select_polygon", f"WITH {PLACES} SELECT s_suppkey FROM p WHERE x < 10 AND y > -0.5 AND y < 2 * x - 0.5")
def select_polygon(spark, d):
    return geometry.select_polygon(places(spark, d), [(0, -0.5), (10, -0.5), (10, 19.5)]).select("s_suppkey")


@register("select_line", f"WITH {PLACES} SELECT s_suppkey FROM p WHERE CASE WHEN x < 2 THEN sqrt((x - 2) ** 2 + (y - 10) ** 2) WHEN x > 14 THEN sqrt((x - 14) ** 2 + (y - 10) ** 2) ELSE abs(y - 10) END <= 2.25")
def select_line(spark, d):
    return geometry.select_line(places(spark, d), 2, 10, 14, 10, 2.25).select("s_suppkey")


@register("extent", f"WITH {PLACES} SELECT round(min(x), 6) AS x0, min(y) AS y0, round(max(x), 6) AS x1, max(y) AS y1, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS diagonal FROM p")
def extent(spark, d):
    return rounded(geometry.extent(places(spark, d)), "x0", "x1", "diagonal")


@register("voronoi_rook", f"WITH {LATTICE} SELECT a.id AS src, b.id AS dst, CAST(1 AS DOUBLE) AS weight FROM g a JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) = 1")
def voronoi_rook(spark, d):
    return geometry.voronoi_weights(lattice(spark), "id")


@register("voronoi_queen", f"WITH {LATTICE} SELECT a.id AS src, b.id AS dst, CAST(1 AS DOUBLE) AS weight FROM g a JOIN g b ON greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1")
def voronoi_queen(spark, d):
    return geometry.voronoi_weights(lattice(spark), "id", queen=True)


@register("voronoi_cells", f"WITH {LATTICE} SELECT id, round(CAST(CASE WHEN x IN (0, 6) THEN 0.62 ELSE 1 END AS DOUBLE) * (CASE WHEN y IN (0, 4) THEN 0.62 ELSE 1 END), 6) AS area FROM g")
def voronoi_cells(spark, d):
    return rounded(geometry.voronoi_polygons(lattice(spark), "id").select("id", F.abs(ring_area(F.col("rings")[0])).alias("area")), "area")


@register("circle_cartogram")
def circle_cartogram(spark, d):
    return geometry.circle_cartogram(places(spark, d), "s_suppkey", "s_acctbal")


@register("distance_scatter", f"""
WITH {PAIRS}, m AS (SELECT stddev_samp(s_acctbal) AS s FROM supplier)
SELECT src, dst, round(d.d, 6) AS d, round(abs(a.s_acctbal - b.s_acctbal) / s, 6) AS value_d FROM d JOIN p a ON a.s_suppkey = src JOIN p b ON b.s_suppkey = dst, m WHERE d.d <= 2.5 AND src < dst""")
def distance_scatter(spark, d):
    return rounded(autocorr.distance_scatter(places(spark, d), "s_suppkey", ["s_acctbal"], 2.5), "d", "value_d")


@register("covariogram", f"""
WITH {PAIRS}, m AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier)
SELECT src, dst, round(d.d, 6) AS d, round((a.s_acctbal - m) / s * (b.s_acctbal - m) / s, 6) AS product FROM d JOIN p a ON a.s_suppkey = src JOIN p b ON b.s_suppkey = dst, m WHERE d.d <= 2.5 AND src < dst""")
def covariogram(spark, d):
    return rounded(autocorr.covariogram(places(spark, d), "s_suppkey", "s_acctbal", 2.5), "d", "product")


@register("cluster_match", """
WITH c AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 2 AS b FROM part), n AS (SELECT a, b, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS k FROM c GROUP BY a, b)
SELECT p_partkey, CAST(k AS INTEGER) AS cluster FROM c JOIN n USING (a, b)""")
def cluster_match(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("a"), (F.col("p_partkey") % 2).alias("b"))
    return autocorr.cluster_match(p, "p_partkey", "a", "b")


@register("local_moran_eb", f"""
WITH {W}, {RATE}, s AS (SELECT sum(event) / sum(base) AS b, sum(base) AS p, count(*) FILTER (base > 0) AS n FROM r), q AS (SELECT any_value(b) AS b, greatest(0, sum(base * (event / base - b) ** 2) / any_value(p) - any_value(b) / (any_value(p) / any_value(n))) AS a FROM r, s),
e AS (SELECT s_suppkey, (event / base - b) / sqrt(a + b / base) AS e FROM r, q), u AS (SELECT src, dst FROM w WHERE src IN (SELECT s_suppkey FROM e) AND dst IN (SELECT s_suppkey FROM e)),
z AS (SELECT s_suppkey, (e - avg(e) OVER ()) / stddev_samp(e) OVER () AS z FROM e WHERE s_suppkey IN (SELECT src FROM u))
SELECT x.s_suppkey, round(any_value(x.z), 5) AS z, round(any_value(x.z) * avg(y.z), 5) AS moran_i FROM z x JOIN u ON src = x.s_suppkey JOIN z y ON dst = y.s_suppkey GROUP BY 1""")
def local_moran_eb(spark, d):
    out = autocorr.eb_moran(rate_supplier(spark, d), "s_suppkey", "event", "base", nation_block(spark, d))
    return rounded(out.where("z is not null").select("s_suppkey", "z", "moran_i"), "z", "moran_i", places=5)


@register("cores_and_neighbours", f"""
WITH {W}, c AS (SELECT s_suppkey FROM supplier WHERE s_acctbal <= 1000)
SELECT s_suppkey, 'core' AS part FROM c UNION ALL SELECT DISTINCT dst, 'neighbour' FROM w WHERE src IN (SELECT s_suppkey FROM c) AND dst NOT IN (SELECT s_suppkey FROM c)""")
def cores_and_neighbours(spark, d):
    s, w = supplier(spark, d), nation_block(spark, d)
    core = autocorr.cores(s, "s_suppkey", 1000.0, "s_acctbal").withColumn("part", F.lit("core"))
    return core.unionByName(autocorr.neighbours_of_cores(s, "s_suppkey", 1000.0, w, "s_acctbal").withColumn("part", F.lit("neighbour")))


@register("averages_test", """
WITH s AS (SELECT count(*) FILTER (p_size <= 25) AS n0, count(*) FILTER (p_size > 25) AS n1, avg(p_retailprice) FILTER (p_size <= 25) AS m0, avg(p_retailprice) FILTER (p_size > 25) AS m1,
var_pop(p_retailprice) FILTER (p_size <= 25) AS v0, var_pop(p_retailprice) FILTER (p_size > 25) AS v1 FROM part)
SELECT 'mean0' AS statistic, round(m0, 6) AS value FROM s UNION ALL SELECT 'mean1', round(m1, 6) FROM s UNION ALL SELECT 'f', round(n0 * n1 / (n0 + n1) * (m0 - m1) ** 2 / ((v0 * n0 + v1 * n1) / (n0 + n1 - 2)), 6) FROM s""")
def averages_test(spark, d):
    found = classify.averages_test(read_table(spark, d, "part").withColumn("big", F.col("p_size") > 25), "p_retailprice", "big")
    return rounded(_numbers(spark, found, "mean0", "mean1", "f"), "value")


@register("difference_in_differences", """
WITH o AS (SELECT o_totalprice AS y, o_orderpriority = '1-URGENT' AS s, year(o_orderdate) >= 1998 AS t FROM orders),
m AS (SELECT avg(y) FILTER (NOT s AND NOT t) AS a, avg(y) FILTER (s AND NOT t) AS b, avg(y) FILTER (NOT s AND t) AS c, avg(y) FILTER (s AND t) AS d FROM o)
SELECT 'CONSTANT' AS variable, round(a, 3) AS coefficient FROM m UNION ALL SELECT 'SPACE', round(b - a, 3) FROM m UNION ALL SELECT 'TIME', round(c - a, 3) FROM m UNION ALL SELECT 'INTERACTION', round(d - c - b + a, 3) FROM m""")
def difference_in_differences(spark, d):
    o = read_table(spark, d, "orders").withColumn("s", F.col("o_orderpriority") == "1-URGENT").withColumn("t", F.year("o_orderdate") >= 1998)
    coefs, _, _ = regression.difference_in_differences(o, "o_orderkey", "o_totalprice", "s", "t")
    return rounded(spark.createDataFrame([(c["variable"], c["coefficient"]) for c in coefs], "variable string, coefficient double"), "coefficient", places=3)
