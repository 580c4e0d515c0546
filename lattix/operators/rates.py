"""Rates and smoothing over an event and a base column (E, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import literal, ratio, scalars


def _cols():
    return F.col("event"), F.col("base")


def _ep(obs: DataFrame, key: str, event: str, base: str) -> DataFrame:
    return obs.select(key, F.col(event).cast("double").alias("event"), F.col(base).cast("double").alias("base"))


def _rate():
    E, P = _cols()
    return F.when(P > 0, E / P)


def raw_rate(obs: DataFrame, key: str, event: str, base: str) -> DataFrame:
    return _ep(obs, key, event, base).select(key, _rate().alias("rate"))


def excess_risk(obs: DataFrame, key: str, event: str, base: str) -> DataFrame:
    E, P = _cols()
    d = _ep(obs, key, event, base)
    s = scalars(d, e=F.sum("event"), p=F.sum("base"))
    expected = P * literal(s["e"] / s["p"] if s["p"] else None)
    return d.select(key, F.when(expected > 0, E / expected).alias("rate"))


def empirical_bayes(obs: DataFrame, key: str, event: str, base: str) -> DataFrame:
    """Shrinks raw rates to the global mean by the method of moments; all rows count to n."""
    E, P = _cols()
    d = _ep(obs, key, event, base)
    s = scalars(d, e=F.sum("event"), p=F.sum("base"), n=F.count("*"))
    t1 = s["e"] / s["p"]
    q2 = scalars(d, q=F.sum(P * F.pow(_rate() - t1, 2)))["q"]
    t2 = max(0.0, q2 / s["p"] - t1 / (s["p"] / s["n"]))
    w = F.when(t2 + t1 / P > 0, t2 / (t2 + t1 / P)).otherwise(1.0)
    return d.select(key, F.when(P > 0, w * E / P + (1 - w) * t1).alias("rate"))


def eb_standardized(obs: DataFrame, key: str, event: str, base: str) -> DataFrame:
    E, P = _cols()
    d = _ep(obs, key, event, base)
    s = scalars(d, e=F.sum("event"), p=F.sum("base"), n=F.count(F.when(P > 0, 1)))
    b = s["e"] / s["p"]
    q = scalars(d, q=F.sum(P * F.pow(_rate() - b, 2)))["q"]
    a = max(0.0, q / s["p"] - b / (s["p"] / s["n"]))
    return d.select(key, F.when(P > 0, ratio(E / P - b, F.sqrt(a + b / P))).alias("rate"))


def _around(d: DataFrame, key: str, w: DataFrame) -> DataFrame:
    """(src, event, base): every observation's own and its neighbours' rows."""
    near = w.where("src <> dst").select("src", "dst").distinct().join(d.withColumnRenamed(key, "dst"), "dst").select("src", "event", "base")
    has = near.select("src").distinct()
    return near.unionByName(d.withColumnRenamed(key, "src").join(has, "src", "left_semi").select("src", "event", "base"))


def spatial_rate(obs: DataFrame, key: str, event: str, base: str, w: DataFrame) -> DataFrame:
    """(E + neighbours' E) / (P + neighbours' P); undefined without neighbours."""
    E, P = _cols()
    d = _ep(obs, key, event, base)
    g = _around(d, key, w).groupBy(F.col("src").alias(key)).agg(F.sum("event").alias("e"), F.sum("base").alias("p"))
    return d.select(key).join(g, key, "left").select(key, F.when(F.col("p") > 0, F.col("e") / F.col("p")).alias("rate"))


def spatial_empirical_bayes(obs: DataFrame, key: str, event: str, base: str, w: DataFrame) -> DataFrame:
    """empirical_bayes() with its moments taken over each observation and its neighbours."""
    E, P = _cols()
    d = _ep(obs, key, event, base)
    around = _around(d, key, w)
    m = around.groupBy("src").agg(F.sum("event").alias("e"), F.sum("base").alias("p"), F.count("*").alias("n"), F.count("event").alias("ne"), F.count("base").alias("np"))
    m = m.where((F.col("n") == F.col("ne")) & (F.col("n") == F.col("np"))).select("src", "p", "n", (F.col("e") / F.nullif("p", F.lit(0.0))).alias("t1"))
    q = around.join(m, "src").groupBy("src").agg(F.sum(P * F.pow(_rate() - F.col("t1"), 2)).alias("q"), F.first("t1").alias("t1"), F.first("p").alias("p"), F.first("n").alias("n"))
    q = q.select(F.col("src").alias(key), "t1", F.greatest(F.lit(0.0), F.col("q") / F.col("p") - F.col("t1") / (F.col("p") / F.col("n"))).alias("t2"))
    spread = F.col("t2") + F.col("t1") / F.nullif(P, F.lit(0.0))
    weight = F.when(spread > 0, F.col("t2") / spread).otherwise(1.0)
    return d.join(q, key, "left").select(key, F.when((P > 0) & F.col("t1").isNotNull(), weight * E / P + (1 - weight) * F.col("t1")).alias("rate"))
