"""Global and local spatial autocorrelation: edge joins for the statistics, counter-based permutations for inference."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import literal, ratio, scalars
from lattix.functions.special import choose, normal_cdf

HH, LL, LH, HL, ISOLATE, UNDEFINED = 1, 2, 3, 4, 5, 6
SIGNIFICANCE = (0.05, 0.01, 0.001, 0.0001, 0.00001)


def usable(obs: DataFrame, key: str, w: DataFrame, *values: str) -> tuple[DataFrame, DataFrame]:
    """Observations with all values defined and a neighbour among those with all values defined; and the edges between them."""
    d = obs.select(F.col(key).alias("id"), *[F.col(v).cast("double").alias(v) for v in values])
    for v in values:
        d = d.where(F.col(v).isNotNull())
    e = w.where("src <> dst").select("src", "dst", "weight")
    e = e.join(d.select(F.col("id").alias("src")), "src", "left_semi").join(d.select(F.col("id").alias("dst")), "dst", "left_semi")
    return d.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi"), e


def standardized(d: DataFrame, *values: str) -> DataFrame:
    s = scalars(d, **{f"m{i}": F.avg(v) for i, v in enumerate(values)}, **{f"s{i}": F.stddev_samp(v) for i, v in enumerate(values)})
    for i, v in enumerate(values):
        d = d.withColumn(v, ratio(F.col(v) - literal(s[f"m{i}"]), literal(s[f"s{i}"])))
    return d


def lagged(d: DataFrame, e: DataFrame, *aggs) -> DataFrame:
    """d joined with aggregates over each observation's neighbours (their columns prefixed n_)."""
    n = d.select(F.col("id").alias("dst"), *[F.col(c).alias(f"n_{c}") for c in d.columns if c != "id"])
    return d.join(e.join(n, "dst").groupBy(F.col("src").alias("id")).agg(*aggs), "id")


def local_moran(obs: DataFrame, key: str, x: str, w: DataFrame, y: str | None = None, median: bool = False) -> DataFrame:
    """(key, z, lag, moran_i, quadrant); y: bivariate (x here, y around); median: the neighbours' median."""
    y = y or x
    names = [x] if y == x else [x, y]
    d, e = usable(obs, key, w, *names)
    d = standardized(d, *names)
    out = lagged(d, e, (F.median(f"n_{y}") if median else F.avg(f"n_{y}")).alias("__lag"))
    z, l = F.col(x), F.col("__lag")
    quadrant = F.when((z < 0) & (l < 0), LL).when((z < 0) & (l > 0), LH).when((z > 0) & (l < 0), HL).otherwise(HH)
    out = out.select(F.col("id").alias(key), z.alias("z"), l.alias("lag"), (z * l).alias("moran_i"), quadrant.alias("quadrant"))
    rest = obs.select(key, F.when(F.col(x).isNull() | F.col(y).isNull(), UNDEFINED).otherwise(ISOLATE).alias("__q"))
    return rest.join(out, key, "left").withColumn("quadrant", F.coalesce("quadrant", "__q")).drop("__q")


def global_moran(obs: DataFrame, key: str, x: str, w: DataFrame, y: str | None = None) -> DataFrame:
    """One row (n, moran_i): the slope of the neighbours' mean on the own value."""
    y = y or x
    d, e = usable(obs, key, w, *([x] if y == x else [x, y]))
    d = standardized(d, *([x] if y == x else [x, y]))
    return lagged(d, e, F.avg(f"n_{y}").alias("__lag")).agg(F.count("*").alias("n"), F.regr_slope("__lag", x).alias("moran_i"))


def differential_moran(obs: DataFrame, key: str, now: str, before: str, w: DataFrame) -> DataFrame:
    return local_moran(obs.withColumn("change", F.col(now) - F.col(before)), key, "change", w)


def local_geary(obs: DataFrame, key: str, xs: list[str], w: DataFrame) -> DataFrame:
    """(key, geary_c): mean over variables of z^2 - 2 z lag(z) + lag(z^2)."""
    d, e = usable(obs, key, w, *xs)
    d = standardized(d, *xs)
    out = lagged(d, e, *[F.avg(f"n_{v}").alias(f"l_{v}") for v in xs], *[F.avg(F.col(f"n_{v}") * F.col(f"n_{v}")).alias(f"q_{v}") for v in xs])
    c = sum([F.col(v) * F.col(v) - 2 * F.col(v) * F.col(f"l_{v}") + F.col(f"q_{v}") for v in xs], F.lit(0.0)) / len(xs)
    return out.select(F.col("id").alias(key), c.alias("geary_c"))


def getis_ord(obs: DataFrame, key: str, x: str, w: DataFrame, star: bool = False) -> DataFrame:
    """(key, g, z): row-standardized G (others only) or G* (with itself) and its normal score."""
    d, e = usable(obs, key, w, x)
    s = scalars(d, n=F.count("*"), s=F.sum(x), q=F.sum(F.col(x) * F.col(x)))
    n, total, sq = s["n"], s["s"] or 0.0, s["q"] or 0.0
    out = lagged(d, e, F.sum(f"n_{x}").alias("__s"), F.count("*").alias("__k"))
    v, k = F.col(x), F.col("__k")
    if star:
        mean, m = total / n if n else 0.0, k + 1
        var = sq / n - mean * mean if n else 0.0
        lag = (F.col("__s") + v) / m
        g = ratio(lag, F.lit(total))
        spread = var * (n / m - 1) / (n - 1)
        z = ratio(lag - mean, F.sqrt(spread))
    else:
        lag = F.col("__s") / k
        g = ratio(lag, F.lit(total) - v)
        mean = (F.lit(total) - v) / (n - 1)
        var = (F.lit(sq) - v * v) / (n - 1) - mean * mean
        z = ratio(lag - mean, F.sqrt(var * ((n - 1) / k - 1) / (n - 2)))
    return out.select(F.col("id").alias(key), g.alias("g"), z.alias("z"))


def join_count(obs: DataFrame, key: str, xs: list[str], w: DataFrame, co_location: bool = True) -> DataFrame:
    """(key, jc): neighbours with the event, where the observation has it (0 elsewhere).

    One variable, several co-located ones (all are 1), or two without co-location (x here, y around).
    """
    d, e = usable(obs, key, w, *xs)
    both = (F.col(xs[0]) == 1) if not co_location else None
    if co_location:
        for v in xs:
            both = (F.col(v) == 1) if both is None else both & (F.col(v) == 1)
        d = d.select("id", both.cast("double").alias("here")).withColumn("there", F.col("here"))
    else:
        d = d.select("id", (F.col(xs[0]) == 1).cast("double").alias("here"), (F.col(xs[1]) == 1).cast("double").alias("there"))
    out = lagged(d, e, F.sum("n_there").alias("__s"))
    return out.select(F.col("id").alias(key), (F.col("here") * F.col("__s")).cast("long").alias("jc"))


def quantile_lisa(obs: DataFrame, key: str, x: str, w: DataFrame, k: int, q: int) -> DataFrame:
    """join_count() of membership in the q-th of k quantile groups (from 1): (break q-1, break q]."""
    from lattix.operators.classify import quantile_breaks

    b = quantile_breaks(obs, x, key, k)
    c = F.col(x)
    inside = F.lit(True) if q == 1 else c > b[q - 2]
    if q < k:
        inside = inside & (c <= b[q - 1])
    return join_count(obs.withColumn("hit", F.when(c.isNotNull(), inside.cast("int"))), key, ["hit"], w)


def multivariate_quantile_lisa(obs: DataFrame, key: str, chosen: list[tuple[str, int, int]], w: DataFrame) -> DataFrame:
    """Co-located join_count() of membership in the q-th of k quantile groups of each variable; chosen: (x, k, q)."""
    from lattix.operators.classify import quantile_breaks

    for i, (x, k, q) in enumerate(chosen):
        b, c = quantile_breaks(obs, x, key, k), F.col(x)
        inside = (F.lit(True) if q == 1 else c > b[q - 2]) & (F.lit(True) if q == k else c <= b[min(q, k - 1) - 1])
        obs = obs.withColumn(f"__hit{i}", F.when(c.isNotNull(), inside.cast("int")))
    return join_count(obs, key, [f"__hit{i}" for i in range(len(chosen))], w)


def neighbour_match(space: DataFrame, attribute: DataFrame, obs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, shared, p): neighbours common to two k-nearest graphs, and the chance of exactly that many."""
    n = scalars(obs, n=F.count("*"))["n"]
    shared = space.select("src", "dst").join(attribute.select("src", "dst"), ["src", "dst"], "left_semi").groupBy(F.col("src").alias(key)).agg(F.count("*").alias("shared"))
    p = F.create_map(*[F.lit(v) for i in range(k + 1) for v in (i, choose(k, i) * choose(n - 1 - k, k - i) / choose(n - 1, k))])
    out = obs.select(key).join(shared, key, "left").select(key, F.coalesce("shared", F.lit(0)).cast("int").alias("shared"))
    return out.withColumn("p", p[F.col("shared")])


def correlogram(points: DataFrame, key: str, value: str, max_distance: float, bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """(bin, pairs, autocorrelation): mean of z_i z_j over pairs by distance up to max_distance (cell-bucketed, not all pairs)."""
    from lattix.operators.weights import pairs_within

    d = points.where(F.col(value).isNotNull())
    s = scalars(d, m=F.avg(value), sd=F.stddev_pop(value))
    z = d.select(F.col(key).alias("id"), ratio(F.col(value) - literal(s["m"]), literal(s["sd"])).alias("z"))
    p = pairs_within(d, key, max_distance, x, y).where("src < dst")
    p = p.join(z.select(F.col("id").alias("src"), F.col("z").alias("a")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("b")), "dst")
    width = max_distance / bins
    return p.groupBy(F.least(F.floor(F.col("d") / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("pairs"), F.avg(F.col("a") * F.col("b")).alias("autocorrelation"))


def join_count_ratio(obs: DataFrame, key: str, cluster: str, w: DataFrame) -> DataFrame:
    """(cluster, n, neighbours, same, ratio) of edges that stay within a cluster."""
    c = obs.select(F.col(key).alias("id"), F.col(cluster).alias("c"))
    e = w.where("src <> dst").join(c.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
    g = e.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("neighbours"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("same"))
    n = c.groupBy("c").agg(F.count("*").alias("n"))
    return n.join(g, "c", "left").select(F.col("c").alias("cluster"), "n", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("same", F.lit(0)).alias("same"), F.coalesce(ratio(F.col("same").cast("double"), F.col("neighbours")), F.lit(0.0)).alias("ratio"))


STATISTICS = ("moran", "geary", "g", "g_star", "join_count")
GROUPS = 16  # of observations that share random orders


def _drawn(rng, m: int, k: int, times: int):
    """times rows of k distinct numbers below m, each set equally likely (Floyd's draw: no row of m numbers is made)."""
    import numpy as np

    if k > 256:
        return np.stack([rng.choice(m, k, replace=False, shuffle=False) for _ in range(times)])
    out = np.empty((times, k), np.int64)
    for i, top in enumerate(range(m - k, m)):
        t = rng.integers(0, top + 1, times)
        out[:, i] = np.where((out[:, :i] == t[:, None]).any(axis=1), top, t)
    return out


def _local(statistic: str, own, s1, s2, k, total: float):
    """A local statistic of the own values and the neighbours' sums and sums of squares, variables along the last axis."""
    if statistic == "moran":
        return own[..., 0] * s1[..., 0] / k
    if statistic == "geary":
        return (own * own - 2 * own * s1 / k + s2 / k).mean(axis=-1)
    if statistic == "g":
        return s1[..., 0] / k / (total - own[..., 0])
    if statistic == "g_star":
        return (s1[..., 0] + own[..., 0]) / (k + 1) / total
    return own[..., 0] * s1[..., 0]


def placed(d: DataFrame, values: list[str], limit: int = 20_000_000) -> tuple[DataFrame, object]:
    """d with a place (from 0, by id), and the values by place, broadcast: 8 bytes a value; above `limit` observations this raises."""
    import numpy as np

    from lattix.functions.scalars import with_rank
    from lattix.session import cut

    n = scalars(d, n=F.count("*"))["n"]
    if n > limit:
        raise ValueError("too many observations to send to every task")
    d = cut(with_rank(d, [F.col("id")], "place").withColumn("place", F.col("place") - 1))
    got = d.select("place", *values).toArrow()
    table = np.empty((n, len(values)))
    table[got.column(0).to_numpy()] = np.stack([got.column(i + 1).to_numpy() for i in range(len(values))], axis=1)
    return d, d.sparkSession.sparkContext.broadcast(table)


def permute(
    obs: DataFrame, key: str, x: str | list[str], w: DataFrame, permutations: int = 999, seed: int = 123456789, statistic: str = "moran", y: str | None = None
) -> DataFrame:
    """(key, statistic, pseudo_p, significance): conditional permutation inference of a local statistic.

    moran: x here, y (or x) around; geary: one or several x; g and g_star: one x; join_count: x is 1 (all, if several), or x here
    and y around; its p is undefined where the count is 0.  Each observation's neighbours are drawn from all others without
    replacement: for every permutation a group of observations (by hash of the key) shares one random order of all places, and
    an observation takes the first of it that are not itself, as many as it has neighbours.  Sums of the order's beginnings
    are made once, so a permutation costs the largest number of neighbours plus one step an observation, not their product.
    Draws depend on (seed, group) alone, not on partitioning.  The values of all observations (8 bytes each) are broadcast to
    the tasks; above 20 million observations this raises.
    """
    import numpy as np
    import pyarrow as pa

    from lattix.session import cut

    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}: one of {', '.join(STATISTICS)}")
    xs = [x] if isinstance(x, str) else list(x)
    if y and statistic not in ("moran", "join_count"):
        raise ValueError(f"{statistic} has no second variable")
    if len(xs) > 1 and statistic not in ("geary", "join_count") or len(xs) > 1 and y:
        raise ValueError(f"{statistic} takes one variable here")
    d, e = usable(obs, key, w, *dict.fromkeys([*xs, *([y] if y else [])]))
    d = cut(d)
    if statistic in ("moran", "geary"):
        d = standardized(d, *dict.fromkeys([*xs, *([y] if y else [])]))
    if statistic == "join_count":
        here = F.lit(True)
        for v in xs:
            here = here & (F.col(v) == 1)
        d = d.select("id", here.cast("double").alias("o0"), ((F.col(y) == 1) if y else here).cast("double").alias("v0"))
    else:
        d = d.select("id", *[F.col(v).alias(f"o{i}") for i, v in enumerate(xs)], *[F.col(y or v).alias(f"v{i}") for i, v in enumerate(xs)])
    m = 1 if statistic == "join_count" else len(xs)
    vs = [f"v{i}" for i in range(m)]
    d, spread = placed(d, vs)
    total = scalars(d, t=F.sum("v0"))["t"] or 0.0
    sums = [F.sum(f"n_{v}").alias(f"a_{v}") for v in vs] + [F.sum(F.col(f"n_{v}") * F.col(f"n_{v}")).alias(f"q_{v}") for v in vs]
    rows = lagged(d.select("id", *vs), e, *sums, F.count("*").alias("k")).drop(*vs).join(d.drop(*vs), "id")
    asked = rows.select("id", "place", F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("g"), "k", *[f"o{i}" for i in range(m)], *[f"a_{v}" for v in vs], *[f"q_{v}" for v in vs])
    kind = d.schema["id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        everyone = spread.value
        n = len(everyone)
        place, ks = t.column(1).to_numpy(), t.column(3).to_numpy()
        own, s1, s2 = (np.stack([t.column(4 + j * m + i).to_numpy() for i in range(m)], axis=1) for j in range(3))
        wide = (lambda v: v[:, None]) if statistic == "geary" else (lambda v: v)
        got = _local(statistic, own, s1, s2, wide(ks), total)
        near = 1e-12 * np.maximum(1.0, np.abs(got))
        k = np.minimum(ks, n - 1)
        top = int(k.max())
        mine = everyone[place]
        rng = np.random.Generator(np.random.Philox(key=[seed, int(t.column(2)[0].as_py())]))
        at = np.full(n, n, np.int64)
        low, high, mean = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64), np.zeros(len(got))
        for _ in range(permutations):
            order = rng.choice(n, top + 1, replace=False)
            at[order] = np.arange(top + 1)
            v = everyone[order]
            first, square = (np.vstack([np.zeros((1, m)), np.cumsum(a, axis=0)]) for a in (v, v * v))
            inside = at[place] < k
            at[order] = n
            upto, less = k + inside, np.where(inside[:, None], mine, 0.0)
            sim = _local(statistic, own, first[upto] - less, square[upto] - less * less, wide(k), total)
            low += sim <= got + near
            high += sim >= got - near
            mean += sim / permutations
        count = np.where(got <= mean + near, low, high) if statistic == "geary" else np.minimum(high, permutations - high)
        none = (got == 0) if statistic == "join_count" else np.zeros(len(got), bool)
        return pa.table({"id": t.column(0), "statistic": got.astype(float), "pseudo_p": pa.array((count + 1) / (permutations + 1), mask=none)})

    out = asked.repartition(GROUPS, "g").groupBy("g").applyInArrow(lambda t: run(t), f"id {kind}, statistic double, pseudo_p double")
    bins = sum([(F.col("pseudo_p") <= b).cast("int") for b in SIGNIFICANCE], F.lit(0))
    return out.select(F.col("id").alias(key), "statistic", "pseudo_p", bins.alias("significance"))


def shuffled(at, n: int, turn: int, seed: int):
    """The places of `at` in the turn-th random order of n places.

    A Feistel network over the least even number of bits that holds n, walked until the place is below n: a
    bijection whose every value is had by itself, so no order is ever made or sent.
    """
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key=[seed, turn])).integers(0, 1 << 63, 6).astype(np.uint64)
    out = np.asarray(at).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            f = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permute_global(obs: DataFrame, key: str, x: str, w: DataFrame, permutations: int = 999, seed: int = 123456789, y: str | None = None) -> DataFrame:
    """One row (statistic, mean, deviation, z, pseudo_p): sum of z times the neighbours' mean over n - 1, against random maps.

    Every task computes its edges' part under all maps; only one sum a map and partition is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    names = list(dict.fromkeys([x, y or x]))
    d, e = usable(obs, key, w, *names)
    d, spread = placed(standardized(d, *names), names)
    ends = e.join(d.select(F.col("id").alias("src"), F.col("place").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("place").alias("b")), "dst")
    edges = ends.join(ends.groupBy("a").agg(F.count("*").alias("k")), "a").select("a", "b", (1.0 / F.col("k")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spread.value
        n = len(table)
        sums = np.zeros(permutations + 1)
        for batch in batches:
            a, b, part = (batch.column(i).to_numpy() for i in range(3))
            nodes, back = np.unique(np.r_[a, b], return_inverse=True)
            for turn in range(permutations + 1):
                at = shuffled(nodes, n, turn, seed) if turn else nodes
                sums[turn] += (table[at, 0][back[: len(a)]] * table[at, -1][back[len(a) :]] * part).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations + 1)), pa.array(sums / max(1, n - 1))], names=["turn", "s"])

    got = edges.mapInArrow(run, "turn bigint, s double").groupBy("turn").agg(F.sum("s").alias("s")).orderBy("turn").toArrow().column("s").to_numpy()
    if not len(got):
        got = np.zeros(permutations + 1)
    own, sims = float(got[0]), got[1:]
    above = int((sims >= own - 1e-12).sum())
    mean, sd = float(sims.mean()), float(sims.std(ddof=1)) if permutations > 1 else None
    row = (own, mean, sd, (own - mean) / sd if sd else None, (min(above, permutations - above) + 1) / (permutations + 1))
    return obs.sparkSession.createDataFrame([row], "statistic double, mean double, deviation double, z double, pseudo_p double")


def bonferroni(p: DataFrame, alpha: float) -> float:
    return alpha / scalars(p, n=F.count("*"))["n"]


def false_discovery(p: DataFrame, key: str, alpha: float, column: str = "pseudo_p") -> float:
    """Walks sorted p-values while p_(i) < i alpha / n and stops at the first failure; the bound is i alpha / n of the last
    success (alpha / n if the first fails)."""
    from lattix.functions.scalars import with_rank

    n = scalars(p, n=F.count("*"))["n"]
    r = with_rank(p.select(key, column), [F.col(column), F.col(key)])
    first = scalars(r.where(F.col(column) >= F.col("rank") * alpha / n), i=F.min("rank"))["i"]
    return max(1, (first or n + 1) - 1) * alpha / n


def getis_p(z: float) -> float:
    """One-sided normal p of a G score."""
    return 1 - normal_cdf(abs(z))


def eb_moran(obs: DataFrame, key: str, event: str, base: str, w: DataFrame) -> DataFrame:
    """local_moran() of empirical-Bayes standardized rates."""
    from lattix.operators.rates import eb_standardized

    return local_moran(eb_standardized(obs, key, event, base), key, "rate", w)


def cores(p: DataFrame, key: str, alpha: float, column: str = "pseudo_p") -> DataFrame:
    """Keys of significant observations."""
    return p.where(F.col(column) <= alpha).select(key)


def neighbours_of_cores(p: DataFrame, key: str, alpha: float, w: DataFrame, column: str = "pseudo_p") -> DataFrame:
    """Keys adjacent to a significant observation that are not significant themselves."""
    c = cores(p, key, alpha, column)
    near = w.where("src <> dst").join(c.select(F.col(key).alias("src")), "src", "left_semi").select(F.col("dst").alias(key)).distinct()
    return near.join(c, key, "left_anti")


def distance_scatter(points: DataFrame, key: str, xs: list[str], max_distance: float, x: str = "x", y: str = "y", kind: str = "euclidean", space: str = "euclidean") -> DataFrame:
    """(src, dst, d, value_d) of pairs src < dst up to max_distance: distance in space against distance of standardized values."""
    from lattix.operators.weights import pairs_within

    v = standardized(points.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs)]).dropna(), *[f"v{i}" for i in range(len(xs))])
    p = pairs_within(points, key, max_distance, x, y, space).where("src < dst")
    for end in ("src", "dst"):
        p = p.join(v.select(F.col("id").alias(end), *[F.col(f"v{i}").alias(f"{end}{i}") for i in range(len(xs))]), end)
    gaps = [F.col(f"src{i}") - F.col(f"dst{i}") for i in range(len(xs))]
    far = sum((F.abs(g) for g in gaps), F.lit(0.0)) if kind == "manhattan" else F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    return p.select("src", "dst", "d", far.alias("value_d"))


def covariogram(points: DataFrame, key: str, value: str, max_distance: float, x: str = "x", y: str = "y") -> DataFrame:
    """(src, dst, d, product) of pairs src < dst up to max_distance: product of values standardized with the variance over n."""
    from lattix.operators.weights import pairs_within

    d = points.where(F.col(value).isNotNull())
    s = scalars(d, m=F.avg(value), sd=F.stddev_pop(value))
    z = d.select(F.col(key).alias("id"), ratio(F.col(value) - literal(s["m"]), literal(s["sd"])).alias("z"))
    p = pairs_within(d, key, max_distance, x, y).where("src < dst")
    p = p.join(z.select(F.col("id").alias("src"), F.col("z").alias("a")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("b")), "dst")
    return p.select("src", "dst", "d", (F.col("a") * F.col("b")).alias("product"))


def cluster_match(df: DataFrame, key: str, *clusters: str) -> DataFrame:
    """(key, cluster): observations alike in every clustering share a class, numbered by falling size."""
    from lattix.operators.cluster import relabel

    d = df.dropna(subset=list(clusters)).select(key, F.struct(*clusters).alias("cluster"))
    return relabel(d, key, "cluster")
