"""Queries over the table operators, calculators, expressions, rates and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import expressions
from lattix.operators import calculators, classify, rates, table, weights
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


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def supplier(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").withColumn("x", F.col("s_acctbal"))


def nation_block(spark: SparkSession, d: str) -> DataFrame:
    return weights.block_weights(supplier(spark, d), "s_suppkey", "s_nationkey")


def rate_supplier(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("event"), F.sum("l_quantity").alias("base"))


W = "w AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)"
RATE = "r AS (SELECT l_suppkey AS s_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS event, sum(l_quantity) AS base FROM lineitem GROUP BY 1)"


@register("merge_left", """
SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s
LEFT JOIN (SELECT n_regionkey, min_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) n ON s.s_nationkey = n.n_regionkey""")
def merge_left(spark, d):
    out = table.merge_left(read_table(spark, d, "supplier"), read_table(spark, d, "nation"), "s_nationkey", "n_regionkey", "n_nationkey")
    return out.select("s_suppkey", "s_name", "n_name")


@register("merge_outer", """
SELECT coalesce(CAST(s_suppkey AS VARCHAR), CAST(n_nationkey AS VARCHAR)) AS key, s_name, n_name FROM supplier FULL JOIN nation ON s_suppkey = n_nationkey""")
def merge_outer(spark, d):
    return table.merge_outer(read_table(spark, d, "supplier"), read_table(spark, d, "nation"), "s_suppkey", "n_nationkey").select("key", "s_name", "n_name")


@register("append_rows", """
SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region""")
def append_rows(spark, d):
    a = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    return table.append(a, read_table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@register("aggregate", """
SELECT s_nationkey, count(*) AS agg_count, round(sum(s_acctbal), 6) AS s_acctbal_sum, round(avg(s_acctbal), 6) AS s_acctbal_avg, max(s_acctbal) AS s_acctbal_max, min(s_acctbal) AS s_acctbal_min FROM supplier GROUP BY 1""")
def aggregate(spark, d):
    return rounded(table.aggregate(read_table(spark, d, "supplier"), "s_nationkey", "s_acctbal"), "s_acctbal_sum", "s_acctbal_avg")


@register("dissolve_grid", "SELECT CAST(s AS BIGINT) AS strip, CAST(32 AS BIGINT) AS agg_count, CAST(24 AS INTEGER) AS segments FROM range(3) t(s)")
def dissolve_grid(spark, d):
    cells = table.grid(spark, 8, 12).withColumn("strip", F.floor(F.col("col") / 4))
    return table.dissolve(cells, "cell", "strip", "rings").select("strip", "agg_count", F.size("outline").alias("segments"))


@register("range_selection", """
SELECT s_suppkey, s_acctbal BETWEEN 1000 AND 5000 AND s_nationkey BETWEEN 3 AND 12 OR s_acctbal BETWEEN 9000 AND 9999 AS selected FROM supplier""")
def range_selection(spark, d):
    s = table.select_range(read_table(spark, d, "supplier"), "s_acctbal", 1000, 5000)
    s = table.select_range(s, "s_nationkey", 3, 12, how="subset")
    return table.select_range(s, "s_acctbal", 9000, 9999, how="append").select("s_suppkey", "selected")


@register("invert_and_save_selection", """
SELECT s_suppkey, CASE WHEN NOT coalesce(s_acctbal BETWEEN 0 AND 4000, false) THEN 1 ELSE 0 END AS flag FROM supplier""")
def invert_and_save(spark, d):
    s = table.invert(table.select_range(read_table(spark, d, "supplier"), "s_acctbal", 0, 4000))
    return table.save_selection(s, "selected", "flag", 1, 0).select("s_suppkey", "flag")


@register("neighbour_selection", f"""
WITH {W}, sel AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)
SELECT s_suppkey, s_suppkey IN (SELECT s_suppkey FROM sel) OR s_suppkey IN (SELECT dst FROM w JOIN sel ON src = s_suppkey) AS selected FROM supplier""")
def neighbour_selection(spark, d):
    s = read_table(spark, d, "supplier").withColumn("selected", F.col("s_acctbal") > 9000)
    return table.add_neighbours(s, "s_suppkey", nation_block(spark, d)).select("s_suppkey", "selected")


@register("sort_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier")
def sort_rank(spark, d):
    from lattix.functions.scalars import with_rank

    return with_rank(read_table(spark, d, "supplier"), [F.col("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "rank")


@register("time_group", """
SELECT n_nationkey AS nation, round(sum(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice END), 2) AS y1995, round(sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END), 2) AS y1996
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1""")
def time_group(spark, d):
    o = read_table(spark, d, "orders").withColumn("t", F.year("o_orderdate")).where("t in (1995, 1996)")
    o = o.join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    long = o.groupBy(F.col("c_nationkey").alias("nation"), "t").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    wide = table.group_time(long, "nation", "t", "v", [1995, 1996])
    return wide.select("nation", F.col("1995").alias("y1995"), F.col("1996").alias("y1996"))


@register("time_ungroup", """
SELECT s_suppkey, t, value FROM (SELECT s_suppkey, 'a' AS t, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal * 2 FROM supplier)""")
def time_ungroup(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_acctbal") * 2).alias("b"))
    return table.ungroup_time(s, "s_suppkey", ["a", "b"])


@register("duplicate_points", """
SELECT c_custkey, copies, first FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS copies, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first FROM customer) WHERE copies > 1""")
def duplicate_points(spark, d):
    return table.duplicates(read_table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_mktsegment").select("c_custkey", "copies", "first")


@register("points_in_polygons", """
SELECT CAST(g AS BIGINT) AS polygon, count(s_suppkey) AS n_points, round(coalesce(sum(s_acctbal), 0), 4) AS v_sum, round(coalesce(avg(s_acctbal), 0), 4) AS v_mean, round(coalesce(median(s_acctbal), 0), 4) AS v_median, round(coalesce(stddev_pop(s_acctbal), 0), 4) AS v_sd
FROM range(30) t(g) LEFT JOIN supplier ON s_acctbal >= (g % 6) * 2000 AND s_acctbal < (g % 6 + 1) * 2000 AND s_nationkey + 0.5 > (g // 6) * 5 AND s_nationkey + 0.5 < (g // 6 + 1) * 5 GROUP BY 1""")
def points_in_polygons(spark, d):
    p = supplier(spark, d).withColumn("y", F.col("s_nationkey") + 0.5)
    out = table.count_points(p, table.grid(spark, 5, 6, 0, 0, 12000, 25), "s_suppkey", "cell", 2500.0, value="s_acctbal")
    return rounded(out, "v_sum", "v_mean", "v_median", "v_sd", places=4)


@register("assign_polygon", """
SELECT s_suppkey AS point, CASE WHEN s_acctbal >= 0 THEN CAST(floor((s_nationkey + 0.5) / 5) * 6 + floor(s_acctbal / 2000) AS BIGINT) ELSE -1 END AS polygon FROM supplier""")
def assign_polygon(spark, d):
    p = supplier(spark, d).withColumn("y", F.col("s_nationkey") + 0.5)
    return table.assign_polygon(p, table.grid(spark, 5, 6, 0, 0, 12000, 25), "s_suppkey", "cell", 2500.0)


@register("create_grid", """
SELECT CAST(i AS BIGINT) AS cell, CAST(i // 4 AS BIGINT) AS "row", CAST(i % 4 AS BIGINT) AS col, round(1.0 / 12, 6) AS area, round(2 * (1.0 / 3 + 0.25), 6) AS perimeter, round((i % 4 + 0.5) / 4, 6) AS cx FROM range(12) t(i)""")
def create_grid(spark, d):
    g = table.grid(spark, 3, 4)
    ring = F.col("rings")[0]
    out = g.select("cell", "row", "col", table.ring_area(ring).alias("area"), table.ring_length(ring).alias("perimeter"), table.mean_centre(ring)["x"].alias("cx"))
    return rounded(out, "area", "perimeter", "cx")


@register("calculator_unary", """
SELECT s_suppkey, round(-s_acctbal, 6) AS neg, round(1 / nullif(s_acctbal, 0), 9) AS inv, round(CASE WHEN s_acctbal >= 0 THEN sqrt(s_acctbal) END, 6) AS root, round(CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END, 6) AS lg, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 6) AS nat FROM supplier""")
def calculator_unary(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    for op, name in (("negate", "neg"), ("invert", "inv"), ("sqrt", "root"), ("log10", "lg"), ("ln", "nat")):
        s = calculators.unary(s, op, "s_acctbal", name)
    return rounded(rounded(s.drop("s_acctbal"), "inv", places=9), "neg", "root", "lg", "nat")


@register("calculator_binary", """
SELECT p_partkey, p_size + p_retailprice AS added, p_size - p_retailprice AS taken, p_size * p_retailprice AS times, round(p_retailprice / nullif(p_size, 0), 6) AS divided, round(pow(p_size, 0.5), 6) AS powered FROM part""")
def calculator_binary(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(0.5).alias("half"))
    for op, a, b, name in (("add", "p_size", "p_retailprice", "added"), ("subtract", "p_size", "p_retailprice", "taken"), ("multiply", "p_size", "p_retailprice", "times"), ("divide", "p_retailprice", "p_size", "divided"), ("power", "p_size", "half", "powered")):
        p = calculators.binary(p, op, a, b, name)
    return rounded(p.drop("p_size", "p_retailprice", "half"), "divided", "powered")


@register("calculator_rescale", """
WITH m AS (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), a AS (SELECT avg(abs(s_acctbal - m)) AS mad FROM supplier, m)
SELECT s_suppkey, round(s_acctbal - m, 6) AS deviation, round((s_acctbal - m) / sd, 6) AS standardize, round((s_acctbal - m) / mad, 6) AS mad, round(s_acctbal / (hi - lo), 6) AS range_adjust, round((s_acctbal - lo) / (hi - lo), 6) AS range_standardize FROM supplier, m, a""")
def calculator_rescale(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    for op in calculators.SCALED:
        s = calculators.rescale(s, op, "s_acctbal", op)
    return rounded(s.drop("s_acctbal"), *calculators.SCALED)


@register("enumerate_rotate", """
SELECT s_suppkey, 5 + 0.5 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS num,
  coalesce(lead(s_acctbal) OVER (ORDER BY s_suppkey), first_value(s_acctbal) OVER (ORDER BY s_suppkey)) AS up, coalesce(lag(s_acctbal) OVER (ORDER BY s_suppkey), (SELECT max_by(s_acctbal, s_suppkey) FROM supplier)) AS down FROM supplier""")
def enumerate_rotate(spark, d):
    s = calculators.enumerate_rows(read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "num", 5, 0.5)
    s = calculators.rotate(s, "s_suppkey", "s_acctbal", "up", True)
    return calculators.rotate(s, "s_suppkey", "s_acctbal", "down", False).drop("s_acctbal")


@register("shuffle_column")
def shuffle_column(spark, d):
    return calculators.shuffle(read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", "mixed", 7)


@register("random_columns")
def random_columns(spark, d):
    return read_table(spark, d, "supplier").select("s_suppkey", calculators.uniform(F.col("s_suppkey"), 3).alias("u"), calculators.normal(F.col("s_suppkey"), 5, 10, 2).alias("z"))


@register("date_parts", """
SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, CAST(second(ts) AS BIGINT) AS second FROM events""")
def date_parts(spark, d):
    e = read_table(spark, d, "events").select("event_id", "ts")
    for p in calculators.DATE_PARTS:
        e = calculators.date_part(e, p, "ts", p)
    return e.drop("ts")


@register("expression_assign", f"""
WITH {W}, l AS (SELECT src, avg(s_acctbal) AS lag FROM w JOIN supplier ON dst = s_suppkey GROUP BY 1), c AS (SELECT src, count(*) AS n FROM w GROUP BY 1), m AS (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd FROM supplier)
SELECT s_suppkey, round((s_acctbal - m) / sd + 2 * lag / 1000 - coalesce(n, 0) + (CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END), 6) AS v FROM supplier CROSS JOIN m LEFT JOIN l ON l.src = s_suppkey LEFT JOIN c ON c.src = s_suppkey""")
def expression_assign(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"))
    out = expressions.evaluate(s, "s_suppkey", "standardize(bal) + 2 * lag(w, bal) / 1000 - counts(w) + (bal > 0)", "v", {"w": nation_block(spark, d)})
    return rounded(out.select("s_suppkey", "v"), "v")


@register("expression_select", "SELECT s_suppkey FROM supplier, (SELECT avg(s_acctbal) AS m FROM supplier) WHERE (s_acctbal > m) <> (s_nationkey < 10) OR s_suppkey = 7")
def expression_select(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))
    return expressions.select(s, "s_suppkey", "((bal > mean(bal)) XOR (nat < 10)) OR s_suppkey = 7").select("s_suppkey")


def _rate(name: str, f, sql: str, spatial: bool = False):
    def run(spark, d):
        r = rate_supplier(spark, d)
        return rounded(f(r, "s_suppkey", "event", "base", nation_block(spark, d)) if spatial else f(r, "s_suppkey", "event", "base"), "rate")

    register(name, sql)(run)


_rate("raw_rate", rates.raw_rate, f"WITH {RATE} SELECT s_suppkey, round(CASE WHEN base > 0 THEN event / base END, 6) AS rate FROM r")
_rate("excess_risk", rates.excess_risk, f"WITH {RATE} SELECT s_suppkey, round(event / (base * (SELECT sum(event) / sum(base) FROM r)), 6) AS rate FROM r")
_rate("empirical_bayes", rates.empirical_bayes, f"""
WITH {RATE}, g AS (SELECT sum(event) / sum(base) AS t1, sum(base) AS p, count(*) AS n FROM r), v AS (SELECT greatest(0, sum(base * (event / base - t1) ** 2) / any_value(p) - any_value(t1) / (any_value(p) / any_value(n))) AS t2 FROM r, g)
SELECT s_suppkey, round(t2 / (t2 + t1 / base) * event / base + (1 - t2 / (t2 + t1 / base)) * t1, 6) AS rate FROM r, g, v""")
_rate("eb_standardized_rate", rates.eb_standardized, f"""
WITH {RATE}, g AS (SELECT sum(event) / sum(base) AS b, sum(base) AS p, count(*) AS n FROM r), v AS (SELECT greatest(0, sum(base * (event / base - b) ** 2) / any_value(p) - any_value(b) / (any_value(p) / any_value(n))) AS a FROM r, g)
SELECT s_suppkey, round((event / base - b) / sqrt(a + b / base), 6) AS rate FROM r, g, v""")
AROUND = f"{W}, {RATE}, o AS (SELECT src, event, base FROM w JOIN r ON dst = s_suppkey UNION ALL SELECT s_suppkey, event, base FROM r WHERE s_suppkey IN (SELECT src FROM w))"
_rate("spatial_rate", rates.spatial_rate, f"WITH {AROUND} SELECT s_suppkey, round((SELECT sum(o.event) / sum(o.base) FROM o WHERE o.src = r.s_suppkey), 6) AS rate FROM r", True)
_rate("spatial_empirical_bayes", rates.spatial_empirical_bayes, f"""
WITH {AROUND}, m AS (SELECT src, sum(event) / sum(base) AS t1, sum(base) AS p, count(*) AS n FROM o GROUP BY 1), q AS (SELECT o.src, any_value(t1) AS t1, greatest(0, sum(base * (event / base - t1) ** 2) / any_value(p) - any_value(t1) / (any_value(p) / any_value(n))) AS t2 FROM o JOIN m ON o.src = m.src GROUP BY 1)
SELECT s_suppkey, round(CASE WHEN t1 IS NOT NULL THEN CASE WHEN t2 + t1 / base > 0 THEN t2 / (t2 + t1 / base) ELSE 1 END * event / base + (1 - CASE WHEN t2 + t1 / base > 0 THEN t2 / (t2 + t1 / base) ELSE 1 END) * t1 END, 6) AS rate FROM r LEFT JOIN q ON q.src = s_suppkey""", True)

HAZEN = "o AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i, count(*) OVER () AS n FROM supplier), p(p) AS (VALUES {at}), h AS (SELECT p, least(greatest(p * n / 100.0 + 0.5, 1), n) AS s FROM p, (SELECT any_value(n) AS n FROM o)), b AS (SELECT p, (SELECT v FROM o WHERE i = floor(s)) + (s - floor(s)) * ((SELECT v FROM o WHERE i = ceil(s)) - (SELECT v FROM o WHERE i = floor(s))) AS br FROM h)"


def _breaks(spark, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, b double")


@register("percentile_breaks", f"WITH {HAZEN.format(at='(1.0), (10.0), (50.0), (90.0), (99.0)')} SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS i, round(br, 6) AS b FROM b")
def percentile_breaks(spark, d):
    return rounded(_breaks(spark, classify.percentile_breaks(read_table(spark, d, "supplier"), "s_acctbal", "s_suppkey")), "b")


@register("quantile_map", f"WITH {HAZEN.format(at='(20.0), (40.0), (60.0), (80.0)')} SELECT s_suppkey, CAST((SELECT count(*) FROM b WHERE s_acctbal >= br) AS INTEGER) AS category FROM supplier")
def quantile_map(spark, d):
    s = read_table(spark, d, "supplier")
    return classify.assign(s, "s_acctbal", classify.quantile_breaks(s, "s_acctbal", "s_suppkey", 5)).select("s_suppkey", "category")


@register("stddev_map", """
WITH m AS (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd FROM supplier)
SELECT s_suppkey, (s_acctbal >= m - 2 * sd)::INTEGER + (s_acctbal >= m - sd)::INTEGER + (s_acctbal >= m)::INTEGER + (s_acctbal >= m + sd)::INTEGER + (s_acctbal >= m + 2 * sd)::INTEGER AS category FROM supplier, m""")
def stddev_map(spark, d):
    s = read_table(spark, d, "supplier")
    return classify.assign(s, "s_acctbal", classify.stddev_breaks(s, "s_acctbal")).select("s_suppkey", "category")


@register("equal_interval_map", """
WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
SELECT s_suppkey, (s_acctbal >= lo + (hi - lo) * 1 / 4)::INTEGER + (s_acctbal >= lo + (hi - lo) * 2 / 4)::INTEGER + (s_acctbal >= lo + (hi - lo) * 3 / 4)::INTEGER AS category FROM supplier, m""")
def equal_interval_map(spark, d):
    s = read_table(spark, d, "supplier")
    return classify.assign(s, "s_acctbal", classify.equal_breaks(s, "s_acctbal", 4)).select("s_suppkey", "category")


@register("box_map", """
WITH o AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i, count(*) OVER () AS n FROM supplier), s AS (SELECT CASE WHEN n % 2 = 0 THEN (n + 2) / 4.0 ELSE (n + 3) / 4.0 END AS a, (n + 1) / 2.0 AS b, CASE WHEN n % 2 = 0 THEN (3 * n + 2) / 4.0 ELSE (3 * n + 1) / 4.0 END AS c FROM (SELECT any_value(n) AS n FROM o)),
q AS (SELECT (SELECT avg(v) FROM (SELECT v FROM o WHERE i = floor(a) UNION ALL SELECT v FROM o WHERE i = ceil(a))) AS q1, (SELECT avg(v) FROM (SELECT v FROM o WHERE i = floor(b) UNION ALL SELECT v FROM o WHERE i = ceil(b))) AS q2, (SELECT avg(v) FROM (SELECT v FROM o WHERE i = floor(c) UNION ALL SELECT v FROM o WHERE i = ceil(c))) AS q3 FROM s)
SELECT s_suppkey, CASE WHEN s_acctbal < q1 - 1.5 * (q3 - q1) THEN 0 WHEN s_acctbal < q1 THEN 1 WHEN s_acctbal < q2 THEN 2 WHEN s_acctbal <= q3 THEN 3 WHEN s_acctbal <= q3 + 1.5 * (q3 - q1) THEN 4 ELSE 5 END AS category FROM supplier, q""")
def box_map(spark, d):
    return classify.box_categories(read_table(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "category")


@register("natural_breaks_map")
def natural_breaks_map(spark, d):
    s = read_table(spark, d, "supplier")
    return classify.assign(s, "s_acctbal", classify.natural_breaks(s, "s_acctbal", 5)).select("s_suppkey", "category")


@register("unique_values", """
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)
SELECT value, n, CAST(least(10, row_number() OVER (ORDER BY n DESC, value) - 1) AS INTEGER) AS category FROM c""")
def unique_values(spark, d):
    return classify.unique_values(read_table(spark, d, "part"), "p_brand")


@register("histogram", """
WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), g AS (SELECT least(floor((s_acctbal - lo) / ((hi - lo) / 7)), 6) AS bin, count(*) AS n FROM supplier, m GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(7) t(i) LEFT JOIN g ON g.bin = i""")
def histogram(spark, d):
    return classify.histogram(read_table(spark, d, "supplier"), "s_acctbal", 7)


@register("sample_statistics", """
SELECT count(v) AS n, round(avg(v), 4) AS mean, round(var_pop(v), 4) AS var_pop, round(var_samp(v), 4) AS var_samp, round(stddev_pop(v), 4) AS sd_pop, round(stddev_samp(v), 4) AS sd_samp, min(v) AS min, max(v) AS max, round(sum(v), 4) AS sum, round(sum(v * v), 2) AS sum_sq, round(median(v), 4) AS median FROM (SELECT s_acctbal AS v FROM supplier)""")
def sample_statistics(spark, d):
    s = classify.sample_stats(read_table(spark, d, "supplier"), "s_acctbal")
    return rounded(rounded(s, "sum_sq", places=2), "mean", "var_pop", "var_samp", "sd_pop", "sd_samp", "sum", "median", places=4)


@register("spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, d):
    return rounded(classify.spearman(read_table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey"), "rho")


@register("simple_regression", """
SELECT round(regr_intercept(y, x), 6) AS alpha, round(regr_slope(y, x), 6) AS beta, round(regr_r2(y, x), 6) AS r2 FROM (SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS x FROM part)""")
def simple_regression(spark, d):
    r = classify.simple_regression(read_table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), "x", "y")
    return rounded(spark.createDataFrame([(float(r["alpha"]), float(r["beta"]), float(r["r2"]))], "alpha double, beta double, r2 double"), "alpha", "beta", "r2")


@register("colocation_map", """
SELECT p_partkey, CASE WHEN p_size % 3 = p_partkey % 3 THEN CAST(p_size % 3 AS BIGINT) END AS shared FROM part""")
def colocation_map(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).cast("long").alias("a"), (F.col("p_partkey") % 3).alias("b"))
    return classify.colocation(p, ["a", "b"]).select("p_partkey", "shared")


@register("merge_by_order", """
WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS i FROM part)
SELECT s_suppkey, p_name FROM a LEFT JOIN b USING (i)""")
def merge_by_order(spark, d):
    return table.merge_by_order(read_table(spark, d, "supplier"), read_table(spark, d, "part"), "s_suppkey", "p_partkey").select("s_suppkey", "p_name")


@register("select_undefined", "SELECT e.event_id, CASE WHEN value > 50 THEN NULL ELSE value END IS NULL AS selected FROM events e")
def select_undefined(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.when(~F.coalesce(F.col("value") > 50, F.lit(False)), F.col("value")).alias("v"))
    return table.select_undefined(e, "v").select("event_id", "selected")


@register("select_random")
def select_random(spark, d):
    return table.select_random(read_table(spark, d, "part"), "p_partkey", 50).select("p_partkey", "selected")


@register("points_from_table", "SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
def points_from_table(spark, d):
    return table.points_from_table(read_table(spark, d, "customer"), "c_acctbal", "c_nationkey").select("c_custkey", "x", "y")


@register("parse_dates", "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 2 THEN strftime(o_orderdate, '%H%M%S') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') ELSE strftime(o_orderdate, '%Y%m%d000000') END AS BIGINT) AS t FROM orders")
def parse_dates(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "HH:mm:ss"))
    return calculators.parse_dates(read_table(spark, d, "orders").select("o_orderkey", text.alias("text")), "text", "t").select("o_orderkey", "t")


@register("scatter_matrix", """
WITH v AS (SELECT p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part)
SELECT 'p_retailprice' AS x, 'p_size' AS y, count(*) AS n, round(regr_slope(b, a), 6) + 0 AS slope, round(regr_intercept(b, a), 6) + 0 AS intercept, round(regr_r2(b, a), 6) + 0 AS r2 FROM v
UNION ALL SELECT 'p_size', 'p_retailprice', count(*), round(regr_slope(a, b), 6) + 0, round(regr_intercept(a, b), 6) + 0, round(regr_r2(a, b), 6) + 0 FROM v""")
def scatter_matrix(spark, d):
    return rounded(classify.scatter_matrix(read_table(spark, d, "part"), ["p_retailprice", "p_size"]), "slope", "intercept", "r2")


@register("conditional_cells", """
SELECT CAST((p_size >= 10)::INT + (p_size >= 30)::INT AS INTEGER) AS across, CAST((p_partkey % 7 >= 3)::INT AS INTEGER) AS down, count(*) AS n, round(avg(p_retailprice), 6) + 0 AS mean, round(stddev_samp(p_retailprice), 6) + 0 AS deviation FROM part GROUP BY 1, 2""")
def conditional_cells(spark, d):
    p = read_table(spark, d, "part").withColumn("m", F.col("p_partkey") % 7)
    return rounded(classify.conditional(p, "p_retailprice", "p_size", "m", [10, 30], [3]), "mean", "deviation")


@register("area_centroids", "SELECT CAST(i AS BIGINT) AS cell, 0.5 AS area, round(i % 8 + 1 / 3, 6) AS x, round(i // 8 + 1 / 3, 6) AS y FROM range(48) t(i)")
def area_centroids(spark, d):
    x, y = F.col("id") % 8, F.floor(F.col("id") / 8)
    at = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    polys = spark.range(48).select(F.col("id").alias("cell"), F.array(F.array(at(0, 0), at(1, 0), at(0, 1))).alias("rings"))
    return rounded(table.centroids(polys, "cell"), "x", "y")
