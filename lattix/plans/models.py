"""Queries over regression, clustering and dimension reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import cluster, regression, weights
from lattix.plans.spatial import PAIRS, cells, places
from lattix.plans.tables import nation_block, rounded, supplier
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


def _part(spark, d):
    return read_table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", (F.col("p_partkey") % 7).alias("m"))


def near_places(spark, d):
    return weights.knn_weights(places(spark, d), "s_suppkey", 6)


NORMAL = "s AS (SELECT count(*) AS n, avg(p_retailprice) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, p_retailprice) AS ay, covar_pop(b, p_retailprice) AS byy, var_pop(p_retailprice) AS yy FROM (SELECT p_retailprice, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) AS b FROM part)), f AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM s)"


@register("ols_coefficients", f"WITH {NORMAL} SELECT 'CONSTANT' AS variable, round(my - b1 * ma - b2 * mb, 6) AS coefficient FROM f UNION ALL SELECT 'p_size', round(b1, 6) FROM f UNION ALL SELECT 'm', round(b2, 6) FROM f")
def ols_coefficients(spark, d):
    coefs, _, _ = regression.ols(_part(spark, d), "p_partkey", "p_retailprice", ["p_size", "m"])
    return rounded(spark.createDataFrame([(c["variable"], c["coefficient"]) for c in coefs], "variable string, coefficient double"), "coefficient")


@register("ols_fit", f"WITH {NORMAL} SELECT round((b1 * ay + b2 * byy) / yy, 6) AS r2, round((yy - b1 * ay - b2 * byy) * n / (n - 3), 4) AS sigma2 FROM f")
def ols_fit(spark, d):
    _, g, _ = regression.ols(_part(spark, d), "p_partkey", "p_retailprice", ["p_size", "m"])
    return rounded(rounded(spark.createDataFrame([(float(g["r2"]), float(g["sigma2"]))], "r2 double, sigma2 double"), "sigma2", places=4), "r2")


@register("ols_residuals", f"WITH {NORMAL} SELECT p_partkey, round(p_retailprice - (my - b1 * ma - b2 * mb) - b1 * p_size - b2 * (p_partkey % 7), 4) AS residual FROM part, f")
def ols_residuals(spark, d):
    return rounded(regression.ols(_part(spark, d), "p_partkey", "p_retailprice", ["p_size", "m"])[2].select("p_partkey", "residual"), "residual", places=4)


@register("ols_spatial_diagnostics")
def ols_spatial_diagnostics(spark, d):
    c = cells(spark, d)
    _, g, _ = regression.ols(c, "p_partkey", "p_retailprice", ["p_size"], weights.lattice_weights(c, "p_partkey"))
    return spark.createDataFrame([(k, float(v)) for k, v in g.items()], "statistic string, value double")


def _ml(kind: str):
    def run(spark, d):
        s = supplier(spark, d).withColumn("k", F.col("s_suppkey") % 5)
        g = regression.ml_model(s, "s_suppkey", "s_acctbal", ["k"], nation_block(spark, d), kind)
        return spark.createDataFrame([(k, float(v)) for k, v in g.items() if not isinstance(v, list)], "statistic string, value double")

    return run


QUERIES["ml_spatial_lag"] = _ml("lag")
QUERIES["ml_spatial_error"] = _ml("error")


@register("dbscan", f"""
WITH RECURSIVE {PAIRS}, n AS (SELECT src, dst FROM d WHERE d <= 1.0), core AS (SELECT s_suppkey AS id FROM supplier WHERE (SELECT count(*) FROM n WHERE src = s_suppkey) + 1 >= 3), e AS (SELECT src, dst FROM n WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
reach AS (SELECT id, id AS to_ FROM core UNION SELECT r.id, e.dst FROM reach r JOIN e ON r.to_ = e.src), comp AS (SELECT id, min(to_) AS c FROM reach GROUP BY 1), member AS (SELECT id, c FROM comp UNION ALL SELECT src, min(c) FROM n JOIN comp ON dst = id WHERE src NOT IN (SELECT id FROM core) GROUP BY 1), num AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS k FROM member GROUP BY 1)
SELECT s_suppkey, CAST(coalesce(k, -1) AS INTEGER) AS cluster FROM supplier LEFT JOIN member ON id = s_suppkey LEFT JOIN num USING (c)""")
def dbscan(spark, d):
    out = cluster.dbscan(places(spark, d), "s_suppkey", 1.0, 3)
    return out.withColumn("cluster", F.col("cluster").cast("int"))


@register("kmeans")
def kmeans(spark, d):
    return cluster.kmeans(read_table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], 5)


@register("kmedians")
def kmedians(spark, d):
    return cluster.kmedians(read_table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], 4)


@register("ward_clusters")
def ward_clusters(spark, d):
    return cluster.hierarchical(supplier(spark, d), "s_suppkey", ["s_acctbal", "s_nationkey"], 4)


@register("skater")
def skater(spark, d):
    return cluster.skater(places(spark, d), "s_suppkey", ["s_acctbal"], 5, near_places(spark, d))


@register("contiguous_clusters")
def contiguous_clusters(spark, d):
    return cluster.hierarchical(places(spark, d), "s_suppkey", ["s_acctbal"], 4, "average", near_places(spark, d))


@register("principal_components", """
WITH r AS (SELECT corr(p_retailprice, p_size) AS r FROM part) SELECT i, round(CASE WHEN i = 1 THEN (1 + abs(r)) / 2 ELSE (1 - abs(r)) / 2 END, 6) AS share FROM r, (VALUES (1), (2)) t(i)""")
def principal_components(spark, d):
    share, _, _ = cluster.pca(read_table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], 2)
    return rounded(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(share)], "i int, share double"), "share")


@register("classic_mds")
def classic_mds(spark, d):
    return cluster.classic_mds(supplier(spark, d), "s_suppkey", ["s_acctbal", "s_nationkey"])
