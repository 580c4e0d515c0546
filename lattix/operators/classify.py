"""Map classification and exploratory statistics.

Order statistics come from scalable ranks (range partitioning), of which only the few
needed places are read; breaks are then plain numbers and assignment is one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import literal, scalars, with_rank


def order_statistics(df: DataFrame, x: str, key: str, places: list[int]) -> dict[int, float]:
    """The values at the given places (from 1) of the sorted defined values."""
    r = with_rank(df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), key), [F.col("x"), F.col(key)])
    return {row["rank"]: row["x"] for row in r.where(F.col("rank").isin(sorted(set(places)))).collect()}


def percentiles(df: DataFrame, x: str, key: str, at: list[float]) -> list[float]:
    """Plotting position 100 (i - 0.5) / n, linear between, held to the extremes."""
    n = scalars(df, n=F.count(x))["n"]
    if not n:
        return [None for _ in at]
    spots = [min(max(p * n / 100 + 0.5, 1.0), float(n)) for p in at]
    v = order_statistics(df, x, key, [i for s in spots for i in (math.floor(s), math.ceil(s))])
    return [v[math.floor(s)] + (s - math.floor(s)) * (v[math.ceil(s)] - v[math.floor(s)]) for s in spots]


def assign(df: DataFrame, x: str, breaks: list[float], into: str = "category") -> DataFrame:
    """Category 0..k: how many breaks are at most x; undefined stays undefined."""
    c = F.col(x).cast("double")
    return df.withColumn(into, F.when(c.isNotNull(), sum([(c >= literal(b)).cast("int") for b in breaks], F.lit(0))))


def quantile_breaks(df: DataFrame, x: str, key: str, k: int) -> list[float]:
    return percentiles(df, x, key, [100 * i / k for i in range(1, k)])


def percentile_breaks(df: DataFrame, x: str, key: str) -> list[float]:
    return percentiles(df, x, key, [1, 10, 50, 90, 99])


def stddev_breaks(df: DataFrame, x: str) -> list[float]:
    s = scalars(df, m=F.avg(x), sd=F.stddev_samp(x))
    return [s["m"] + i * s["sd"] for i in (-2, -1, 0, 1, 2)]


def equal_breaks(df: DataFrame, x: str, k: int) -> list[float]:
    s = scalars(df, lo=F.min(x), hi=F.max(x))
    return [s["lo"] + (s["hi"] - s["lo"]) * i / k for i in range(1, k)]


def hinges(df: DataFrame, x: str, key: str, factor: float = 1.5) -> dict[str, float]:
    """Quartiles by depth (mean of the two order statistics around it) and the fences `factor` spreads out."""
    n = scalars(df, n=F.count(x))["n"]
    q1 = (n + 2) / 4 if n % 2 == 0 else (n + 3) / 4
    q3 = (3 * n + 2) / 4 if n % 2 == 0 else (3 * n + 1) / 4
    spots = {"q1": q1, "q2": (n + 1) / 2, "q3": q3}
    v = order_statistics(df, x, key, [i for s in spots.values() for i in (math.floor(s), math.ceil(s))])
    q = {name: (v[math.floor(s)] + v[math.ceil(s)]) / 2 for name, s in spots.items()}
    spread = q["q3"] - q["q1"]
    return q | {"low": q["q1"] - factor * spread, "high": q["q3"] + factor * spread}


def box_categories(df: DataFrame, x: str, key: str, factor: float = 1.5, into: str = "category") -> DataFrame:
    h = hinges(df, x, key, factor)
    c = F.col(x).cast("double")
    cat = F.when(c < h["low"], 0).when(c < h["q1"], 1).when(c < h["q2"], 2).when(c <= h["q3"], 3).when(c <= h["high"], 4).when(c.isNotNull(), 5)
    return df.withColumn(into, cat)


def natural_breaks(df: DataFrame, x: str, k: int) -> list[float]:
    """Optimal (Fisher-Jenks) breaks over all distinct values with their counts, at every size: the driver holds 16 bytes a
    distinct value in sorted order, and the dynamic programme takes k n log n steps, as optimal cuts never move back."""
    import numpy as np

    c = F.col(x).cast("double")
    groups = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n")).toArrow()
    v, n = groups.column("v").to_numpy(), groups.column("n").to_numpy().astype(float)
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    m, k = len(v), min(k, len(v))
    if k < 2:
        return []
    wide = np.longdouble  # squares of far values beside near ones
    mid = wide((n * v).sum() / n.sum())
    sn, sv, sq = (np.r_[wide(0), np.cumsum(z)] for z in (n.astype(wide), n * (v - mid), n * (v - mid) ** 2))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared deviations of values i..j-1."""
        return np.maximum((sq[j] - sq[i]) - (sv[j] - sv[i]) ** 2 / (sn[j] - sn[i]), 0)

    best = np.r_[wide(np.inf), cost(np.zeros(m, int), np.arange(1, m + 1))]
    backs = []
    for c_ in range(2, k + 1):
        now, back = np.full(m + 1, wide(np.inf)), np.zeros(m + 1, int)
        # divide and conquer, all middles of one depth at once: (ends lo..hi, cuts from..to)
        lo, hi, low, high = (np.array([z]) for z in (c_, m, c_ - 1, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            last = np.minimum(high, j - 1)
            stops = np.cumsum(last - low + 1)
            for part in np.array_split(np.arange(len(j)), max(1, int(stops[-1]) >> 22)):
                if not len(part):
                    continue
                width = (last - low + 1)[part]
                first = np.r_[0, np.cumsum(width)[:-1]]
                i = np.repeat(low[part] - first, width) + np.arange(width.sum())
                total = best[i] + cost(i, np.repeat(j[part], width))
                least = np.minimum.reduceat(total, first)
                place = np.flatnonzero(total == np.repeat(least, width))
                pick = place[np.searchsorted(place, first)]
                now[j[part]], back[j[part]] = least, i[pick]
            left, right = lo < j, j < hi
            lo, hi, low, high = np.r_[lo[left], j[right] + 1], np.r_[j[left] - 1, hi[right]], np.r_[low[left], back[j][right]], np.r_[back[j][left], high[right]]
        best = now
        backs.append(back)
    cuts, j = [], m
    for back in backs[::-1]:
        j = int(back[j])
        cuts.append(float(v[j]))
    return cuts[::-1]


def unique_values(df: DataFrame, x: str, most: int = 10) -> DataFrame:
    """(value, n, category): the `most` commonest values in turn, all others together as `most`."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(most).collect()
    place = F.create_map(*[F.lit(v) for i, r in enumerate(top) for v in (r["value"], i)]) if top else None
    return counts.withColumn("category", F.coalesce(place[F.col("value")], F.lit(most)) if top else F.lit(most))


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin, n): equal widths, right-open, the last closed; empty bins included."""
    c = F.col(x).cast("double")
    s = scalars(df, lo=F.min(c), hi=F.max(c))
    hi = s["hi"] if s["hi"] > s["lo"] else s["hi"] + (abs(s["hi"]) / 2 or 1)
    step = (hi - s["lo"]) / bins
    got = df.where(c.isNotNull()).groupBy(F.least(F.floor((c - s["lo"]) / step), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0)


def sample_stats(df: DataFrame, x: str) -> DataFrame:
    c = F.col(x).cast("double")
    return df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var_pop"), F.var_samp(c).alias("var_samp"), F.stddev_pop(c).alias("sd_pop"),
        F.stddev_samp(c).alias("sd_samp"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.sum(c * c).alias("sum_sq"), F.median(c).alias("median"),
    )


def average_ranks(df: DataFrame, x: str, key: str, into: str) -> DataFrame:
    """Ranks with ties averaged: the rank of a value's first row plus half of the others."""
    r = with_rank(df, [F.col(x), F.col(key)], "__r")
    g = r.groupBy(F.col(x).alias("__x")).agg(F.avg("__r").alias(into))
    return r.join(g, F.col(x) == F.col("__x")).drop("__x", "__r")


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    return average_ranks(average_ranks(d, x, key, "rx"), y, key, "ry").agg(F.corr("rx", "ry").alias("rho"))


def simple_regression(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """alpha, beta, r2, standard errors, t and two-sided p of y on x, from one pass of sums."""
    from lattix.functions.special import t_two_sided

    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = scalars(d, n=F.count("*"), mx=F.avg(x), my=F.avg(y), sxx=F.regr_sxx(y, x), syy=F.regr_syy(y, x), sxy=F.regr_sxy(y, x))
    b = s["sxy"] / s["sxx"]
    a = s["my"] - b * s["mx"]
    rss = max(0.0, s["syy"] - b * s["sxy"])
    df_ = s["n"] - 2
    var = rss / df_
    se_b, se_a = math.sqrt(var / s["sxx"]), math.sqrt(var * (1 / s["n"] + s["mx"] ** 2 / s["sxx"]))
    out = {"n": s["n"], "alpha": a, "beta": b, "r2": 1 - rss / s["syy"], "se_alpha": se_a, "se_beta": se_b, "rss": rss}
    for name, v, se in (("alpha", a, se_a), ("beta", b, se_b)):
        out[f"t_{name}"] = v / se if se else math.inf
        out[f"p_{name}"] = t_two_sided(out[f"t_{name}"], df_) if se else 0.0
    return out


def chow_test(df: DataFrame, x: str, y: str, regime: str) -> dict[str, float]:
    """F test that one line fits both values of a boolean regime as well as two."""
    from lattix.functions.special import f_sf

    whole, parts = simple_regression(df, x, y), [simple_regression(df.where(F.col(regime) == v), x, y) for v in (True, False)]
    u, n = sum(p["rss"] for p in parts), whole["n"]
    f = ((whole["rss"] - u) * (n - 4)) / (u * 2)
    return {"f": f, "p": f_sf(f, 2, n - 4)}


def lowess(df: DataFrame, x: str, y: str, span: float = 0.2, robust: int = 5, most_rows: int = 20_000) -> DataFrame:
    """Locally weighted linear fit with bisquare reweighting, one task (at most `most_rows` rows; more raise)."""
    import numpy as np
    import pandas as pd

    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if scalars(d, n=F.count("*"))["n"] > most_rows:
        raise ValueError(f"lowess takes at most {most_rows} rows")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y"])
        a, b, n = g["x"].to_numpy(), g["y"].to_numpy(), len(g)
        q = max(2, min(n, int(span * n + 1e-10)))
        rob, fit = np.ones(n), b.copy()
        for _ in range(robust + 1):
            for i in range(n):
                dist = np.abs(a - a[i])
                h = np.partition(dist, q - 1)[q - 1]
                w = rob * np.where(dist <= 0.999 * h, (1 - np.minimum(1, (dist / h) if h else 0 * dist) ** 3) ** 3, 0.0) if h else rob * (dist == 0)
                w = w / w.sum()
                c = (w * a).sum()
                v = (w * (a - c) ** 2).sum()
                fit[i] = (w * b).sum() + ((a[i] - c) * (w * (a - c) * b).sum() / v if v > 1e-12 * max(1.0, np.ptp(a) ** 2) else 0)
            r = np.abs(b - fit)
            m = 6 * np.median(r)
            if m < 1e-12:
                break
            rob = (1 - np.minimum(1, r / m) ** 2) ** 2
        return pd.DataFrame({"x": a, "y": b, "fit": fit})

    return d.groupBy(F.lit(1).alias("g")).applyInPandas(lambda g: run(g), "x double, y double, fit double")


def colocation(df: DataFrame, columns: list[str], into: str = "shared") -> DataFrame:
    """The common value of the columns, or undefined where they differ."""
    same = None
    for c in columns[1:]:
        s = F.col(c) == F.col(columns[0])
        same = s if same is None else same & s
    return df.withColumn(into, F.when(same, F.col(columns[0])))


def averages_test(df: DataFrame, x: str, regime: str) -> dict[str, float]:
    """Means of a value inside and outside a regime and the analysis-of-variance F(1, n - 2) of their difference."""
    from lattix.functions.special import f_sf

    r = F.col(regime).cast("int")
    d = df.where(F.col(x).isNotNull() & r.isNotNull())
    s = scalars(d, n0=F.count(F.when(r == 0, 1)), n1=F.count(F.when(r == 1, 1)), m0=F.avg(F.when(r == 0, F.col(x))), m1=F.avg(F.when(r == 1, F.col(x))), v0=F.var_pop(F.when(r == 0, F.col(x))), v1=F.var_pop(F.when(r == 1, F.col(x))))
    n0, n1 = s["n0"], s["n1"]
    if not n0 or not n1 or n0 + n1 < 3:
        return {"n0": n0, "n1": n1, "mean0": s["m0"], "mean1": s["m1"], "f": None, "p": None}
    within = (s["v0"] * n0 + s["v1"] * n1) / (n0 + n1 - 2)
    between = n0 * n1 / (n0 + n1) * (s["m0"] - s["m1"]) ** 2
    f = between / within if within else None
    return {"n0": n0, "n1": n1, "mean0": s["m0"], "mean1": s["m1"], "f": f, "p": None if f is None else f_sf(f, 1, n0 + n1 - 2)}


def scatter_matrix(df: DataFrame, xs: list[str]) -> DataFrame:
    """(x, y, n, slope, intercept, r2) for every ordered pair of variables, over rows with both defined: one pass over df."""
    c = {x: F.col(x).cast("double") for x in xs}
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), c[a].alias("u"), c[b].alias("v")) for a in xs for b in xs if a != b])
    d = df.select(F.explode(rows).alias("r")).select("r.*").where("u is not null and v is not null")
    return d.groupBy("x", "y").agg(F.count("*").alias("n"), F.regr_slope("v", "u").alias("slope"), F.regr_intercept("v", "u").alias("intercept"), F.regr_r2("v", "u").alias("r2"))


def conditional(df: DataFrame, value: str, across: str, down: str, across_breaks: list[float], down_breaks: list[float]) -> DataFrame:
    """(across, down, n, mean, deviation) of a variable in the cells of two classifications; undefined values take no part."""
    d = df.where(F.col(value).isNotNull() & F.col(across).isNotNull() & F.col(down).isNotNull())
    place = lambda c, breaks: sum([(F.col(c) >= b).cast("int") for b in breaks], F.lit(0))
    cells = d.select(place(across, across_breaks).alias("across"), place(down, down_breaks).alias("down"), F.col(value).cast("double").alias("v"))
    return cells.groupBy("across", "down").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"))
