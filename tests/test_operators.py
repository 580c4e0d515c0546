from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.operators import autocorr, classify, cluster, graph, rates, regression, table, weights
from lattix.sources import files


@pytest.fixture(scope="module")
def board(spark):
    """A 6 x 6 checkerboard of +-1 with a smooth second column."""
    return spark.createDataFrame([(i, i % 6, i // 6, float((i % 6 + i // 6) % 2 * 2 - 1), float(i % 6 + 0.1 * i), int((i % 6 + i // 6) % 2)) for i in range(36)], "id long, gx long, gy long, v double, s double, b int")


@pytest.fixture(scope="module")
def rook(board):
    return weights.lattice_weights(board, "id")


def matrix(w, n):
    m = np.zeros((n, n))
    for r in w.collect():
        m[r["src"], r["dst"]] = r["weight"]
    return m


def test_checkerboard(board, rook):
    assert autocorr.global_moran(board, "id", "v", rook).first()["moran_i"] == pytest.approx(-1)
    assert all(r["jc"] == 0 for r in autocorr.join_count(board, "id", ["b"], rook).collect())


def test_constant_column_is_undefined(board, rook):
    out = autocorr.local_moran(board.withColumn("c", F.lit(2.0)), "id", "c", rook)
    assert all(r["z"] is None for r in out.collect())


def test_null_value_is_pruned(spark):
    obs = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, 5.0)], "id long, v double")
    w = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, weight double")
    got = {r["id"]: r["quadrant"] for r in autocorr.local_moran(obs, "id", "v", w).collect()}
    assert got[1] == autocorr.UNDEFINED and got[0] == autocorr.ISOLATE and got[2] in (1, 2, 3, 4)


def test_permutation_is_partition_invariant(board, rook):
    a = {r["id"]: r["pseudo_p"] for r in autocorr.permute(board, "id", "s", rook, 99).collect()}
    b = {r["id"]: r["pseudo_p"] for r in autocorr.permute(board.repartition(7), "id", "s", rook.repartition(3), 99).collect()}
    assert a == b and all(1 / 100 <= p <= 0.51 for p in a.values())


def test_moran_is_affine_invariant(board, rook):
    a = autocorr.global_moran(board, "id", "s", rook).first()["moran_i"]
    assert autocorr.global_moran(board.withColumn("s", 3 - 2 * F.col("s")), "id", "s", rook).first()["moran_i"] == pytest.approx(a)


def test_getis_score_matches_dense(board, rook):
    m = matrix(rook, 36)
    x = np.array([r["s"] for r in board.orderBy("id").collect()])
    k = m.sum(axis=1)
    star = m + np.eye(36)
    var = x.var()
    z = (star @ x / (k + 1) - x.mean()) / np.sqrt(var * (36 / (k + 1) - 1) / 35)
    got = {r["id"]: r["z"] for r in autocorr.getis_ord(board, "id", "s", rook, star=True).collect()}
    assert [got[i] for i in range(36)] == pytest.approx(z.tolist())


def test_false_discovery(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.001, 0.008, 0.039, 0.041, 0.9])], "id long, pseudo_p double")
    assert autocorr.false_discovery(p, "id", 0.05) == pytest.approx(2 * 0.05 / 5)
    assert autocorr.bonferroni(p, 0.05) == pytest.approx(0.01)


def test_percentile_vectors(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([15, 20, 35, 40, 50])], "id long, v double")
    assert classify.percentiles(df, "v", "id", [10, 11, 50, 89, 90]) == pytest.approx([15, 15.25, 35, 49.5, 50])


def test_natural_breaks_of_many_values_with_an_outlier(spark):
    # five runs of 1,400 values far apart for their width, and one value far beyond: with six classes the optimum is plain
    v = [1000.0 * g + i / 14 for g in range(5) for i in range(1400)] + [1e9]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert classify.natural_breaks(df, "v", 6) == [1000.0, 2000.0, 3000.0, 4000.0, 1e9]
    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (2, 2), (40, 5), (300, 4)):
        v = np.unique(rng.integers(0, 500, n)).astype(float) ** 2
        w = rng.integers(1, 4, len(v))
        cost = lambda i, j: (w[i:j] * (v[i:j] - np.average(v[i:j], weights=w[i:j])) ** 2).sum()
        got = classify.natural_breaks(spark.createDataFrame([(x,) for x, c in zip(v.tolist(), w.tolist()) for _ in range(c)], "v double"), "v", k)
        stops = [0, *np.searchsorted(v, got).tolist(), len(v)]
        best = {(0, 0): 0.0}
        for c in range(1, min(k, len(v)) + 1):
            for j in range(c, len(v) + 1):
                best[c, j] = min(best[c - 1, i] + cost(i, j) for i in range(c - 1, j) if (c - 1, i) in best)
        assert len(got) == min(k, len(v)) - 1 and sum(cost(a, b) for a, b in zip(stops, stops[1:])) == pytest.approx(best[min(k, len(v)), len(v)])


def test_natural_breaks_are_optimal(spark):
    from itertools import combinations

    v = sorted({round(float(x), 3) for x in np.random.default_rng(3).gamma(2, 5, 14)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v double")
    cost = lambda cuts: sum(np.var(g) * len(g) for g in np.split(np.array(v), cuts))
    want = min(combinations(range(1, len(v)), 3), key=cost)
    assert classify.natural_breaks(df, "v", 4) == [v[i] for i in want]


def test_aggregate_of_negatives(spark):
    df = spark.createDataFrame([("a", -5.0), ("a", -2.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in table.aggregate(df, "k", "v").collect()}
    assert got["a"]["v_max"] == -2 and got["b"]["agg_count"] == 1 and got["b"]["v_sum"] is None


def test_eb_of_equal_rates_is_the_rate(spark):
    df = spark.createDataFrame([(i, 2.0 * i, 10.0 * i) for i in range(1, 6)] + [(9, 0.0, 0.0)], "id long, e double, p double")
    got = {r["id"]: r["rate"] for r in rates.empirical_bayes(df, "id", "e", "p").collect()}
    assert all(got[i] == pytest.approx(0.2) for i in range(1, 6)) and got[9] is None


def test_components_of_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5000 for i in range(5000, 5400)) and 7 not in got
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ols_matches_dense(spark, board, rook):
    rng = np.random.default_rng(2)
    rows = board.orderBy("id").collect()
    x = rng.normal(size=(36, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=36)
    df = spark.createDataFrame([(r["id"], float(v), float(a), float(b)) for r, v, (a, b) in zip(rows, y, x)], "id long, y double, a double, b double")
    coefs, diag, res = regression.ols(df, "id", "y", ["a", "b"], rook)
    d = np.c_[np.ones(36), x]
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    e = y - d @ beta
    assert [c["coefficient"] for c in coefs] == pytest.approx(beta.tolist())
    m = matrix(rook, 36)
    w = m / m.sum(axis=1, keepdims=True)
    s2 = e @ e / 36
    t = np.trace((w.T + w) @ w)
    proj = np.eye(36) - d @ np.linalg.inv(d.T @ d) @ d.T
    assert diag["lm_error"] == pytest.approx((e @ w @ e / s2) ** 2 / t)
    wxb = w @ d @ beta
    nj = wxb @ proj @ wxb / s2 + t
    assert diag["lm_lag"] == pytest.approx((e @ w @ y / s2) ** 2 / nj)
    a = proj @ w
    mean = np.trace(a) / 33
    var = (np.trace(a @ proj @ w.T) + np.trace(a @ a) + np.trace(a) ** 2) / (33 * 35) - mean**2
    assert diag["moran_e_z"] == pytest.approx((e @ w @ e / (e @ e) - mean) / np.sqrt(var))
    sd = e.std()
    assert diag["jarque_bera"] == pytest.approx(36 / 6 * ((e**3).mean() / sd**3) ** 2 + 36 / 24 * ((e**4).mean() / sd**4 - 3) ** 2)
    assert res.count() == 36


@pytest.mark.parametrize("kind", ["lag", "error"])
def test_ml_recovers_parameter(spark, board, rook, kind):
    rng = np.random.default_rng(5)
    m = matrix(rook, 36)
    w = m / m.sum(axis=1, keepdims=True)
    x, e = rng.normal(size=36) * 3, rng.normal(size=36) * 0.3
    inv = np.linalg.inv(np.eye(36) - 0.6 * w)
    y = inv @ (1 + 2 * x + e) if kind == "lag" else 1 + 2 * x + inv @ e
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "id long, y double, x double")
    got = regression.ml_model(df, "id", "y", ["x"], rook, kind)
    assert got["rho" if kind == "lag" else "lambda"] == pytest.approx(0.6, abs=0.25) and got["beta"][1] == pytest.approx(2, abs=0.2)


def test_linkage_and_skater(spark):
    pts = [(i, float(i // 5 * 100 + i % 5), 0.0) for i in range(15)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    w = weights.distance_band(df, "id", 1000.0, x="a", y="b")
    want = {i: i // 5 + 1 for i in range(15)}
    for method in ("single", "complete", "average", "ward"):
        assert {r["id"]: r["cluster"] for r in cluster.hierarchical(df, "id", ["a"], 3, method).collect()} == want
    assert {r["id"]: r["cluster"] for r in cluster.skater(df, "id", ["a"], 3, w).collect()} == want


def test_sum_of_squares_adds_up(board):
    got = cluster.sum_of_squares(board.withColumn("c", F.col("id") % 3), "c", ["v", "s"])
    assert got["total"] == pytest.approx(70) and got["between"] >= -1e-9


def test_gal_and_gwt_round_trip(board, rook, tmp_path):
    want = {(str(r["src"]), str(r["dst"])) for r in rook.collect()}
    files.write_gal(rook, board, "id", str(tmp_path / "gal"))
    assert {(r["src"], r["dst"]) for r in files.read_gal(board.sparkSession, str(tmp_path / "gal")).collect()} == want
    files.write_gwt(rook, 36, "id", str(tmp_path / "gwt"))
    assert {(r["src"], r["dst"]) for r in files.read_gwt(board.sparkSession, str(tmp_path / "gwt")).collect()} == want


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":1},"geometry":{"type":"Point","coordinates":[2.0,3.0]}},{"type":"Feature","properties":{"n":2},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    got = {r["n"]: r for r in files.read(spark, "geojson", str(tmp_path / "a.geojson")).collect()}
    assert (got[1]["x"], got[1]["y"]) == (2.0, 3.0) and len(got[2]["rings"][0]) == 4


def test_permute_names_its_statistics_and_geary_has_999_draws(board, spark):
    from lattix.plans.catalog import queries

    with pytest.raises(ValueError):
        autocorr.permute(board, "id", "s", board.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")), 9, statistic="ripley")
    got = queries()["local_geary_permutation"](spark, "/root/testdata/sf0.01")
    p = [r["pseudo_p"] for r in got.collect() if r["pseudo_p"] is not None]
    assert p and all(abs(v * 1000 - round(v * 1000)) < 1e-9 for v in p) and any(abs(v * 200 - round(v * 200)) > 1e-9 for v in p)


def test_draws_are_distinct_and_even():
    rng = np.random.default_rng(1)
    got = autocorr._drawn(rng, 5, 2, 20_000)
    assert (got[:, 0] != got[:, 1]).all() and got.min() == 0 and got.max() == 4
    pairs = np.unique(np.sort(got, axis=1), axis=0, return_counts=True)[1]
    assert len(pairs) == 10 and abs(pairs - 2000).max() < 250
    assert autocorr._drawn(rng, 300, 300, 2).tolist() is not None and (np.sort(autocorr._drawn(rng, 300, 300, 2)) == np.arange(300)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 36, 1000])
def test_shuffled_is_a_bijection(n):
    orders = [autocorr.shuffled(np.arange(n), n, t, 7) for t in range(1, 5)]
    assert all((np.sort(o) == np.arange(n)).all() for o in orders)
    assert n < 36 or len({tuple(o) for o in orders}) == 4


@pytest.mark.parametrize("statistic,x,y", [("moran", "v", None), ("moran", "v", "u"), ("geary", ["v"], None), ("geary", ["v", "u"], None), ("g", "v", None), ("g_star", "v", None), ("join_count", ["b"], None), ("join_count", "b", "c")])
def test_permutation_matches_enumeration(spark, statistic, x, y):
    """Six observations: the share of all possible neighbour sets that reach the statistic, counted one by one."""
    from itertools import combinations

    vals = [(0, 1.0, 2.0, 1, 0), (1, 4.0, 1.0, 1, 1), (2, 2.5, 7.0, 0, 1), (3, 9.0, 3.0, 1, 1), (4, 3.0, 4.5, 0, 0), (5, 6.5, 0.5, 1, 1)]
    edges = [(0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 5), (4, 3), (4, 5), (5, 4), (5, 0)]
    obs = spark.createDataFrame(vals, "id long, v double, u double, b int, c int")
    w = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    got = {r["id"]: r for r in autocorr.permute(obs, "id", x, w, 4999, statistic=statistic, y=y).collect()}
    table = {c: np.array([r[i + 1] for r in vals], float) for i, c in enumerate("vubc")}
    if statistic in ("moran", "geary"):
        table = {c: (t - t.mean()) / t.std(ddof=1) for c, t in table.items()}
    xs = [x] if isinstance(x, str) else x

    def value(i, near):
        near = list(near)
        if statistic == "moran":
            return table[xs[0]][i] * table[y or xs[0]][near].mean()
        if statistic == "geary":
            return np.mean([((table[c][i] - table[c][near]) ** 2).mean() for c in xs])
        if statistic == "g":
            return table[xs[0]][near].mean() / (table[xs[0]].sum() - table[xs[0]][i])
        if statistic == "g_star":
            return table[xs[0]][[i, *near]].mean() / table[xs[0]].sum()
        return table[xs[0]][i] * table[y or xs[0]][near].sum()

    for i in range(6):
        own = value(i, [b for a, b in edges if a == i])
        sims = np.array([value(i, c) for c in combinations([j for j in range(6) if j != i], 2)])
        assert got[i]["statistic"] == pytest.approx(own)
        if statistic == "join_count" and own == 0:
            assert got[i]["pseudo_p"] is None
            continue
        if statistic == "geary":
            share = (sims <= own + 1e-9).mean() if own <= sims.mean() + 1e-9 else (sims >= own - 1e-9).mean()
        else:
            share = (sims >= own - 1e-9).mean()
            share = min(share, 1 - share)
        assert got[i]["pseudo_p"] == pytest.approx(share, abs=0.03)


def test_global_permutation(board, rook):
    got = autocorr.permute_global(board, "id", "v", rook, 199).first()
    again = autocorr.permute_global(board.repartition(5), "id", "v", rook.repartition(7), 199).first()
    assert got["statistic"] == pytest.approx(-1) and got["pseudo_p"] == pytest.approx(1 / 200)
    assert abs(got["mean"] + 1 / 35) < 0.06 and got["z"] < -5 and again["mean"] == pytest.approx(got["mean"])
    flat = autocorr.permute_global(board, "id", "s", rook.where("src < 0"), 9).first()
    assert flat["statistic"] == 0


def test_geojson_shapes(spark, tmp_path):
    shapes = [("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]],[[5.1,5.1],[5.2,5.1],[5.2,5.2],[5.1,5.1]]]]"), ("LineString", "[[0,0],[2,1]]"), ("MultiLineString", "[[[0,0],[2,1]],[[3,3],[4,4],[5,5]]]"), ("MultiPoint", "[[1,2],[3,4]]")]
    feats = ",".join(f'{{"type":"Feature","properties":{{"n":{i}}},"geometry":{{"type":"{t}","coordinates":{c}}}}}' for i, (t, c) in enumerate(shapes))
    (tmp_path / "b.geojson").write_text(f'{{"type":"FeatureCollection","features":[{feats}]}}')
    got = {r["n"]: r["rings"] for r in files.read(spark, "geojson", str(tmp_path / "b.geojson")).collect()}
    assert [len(r) for r in got[0]] == [4, 4, 4] and got[0][1][0]["x"] == 5.0
    assert [len(r) for r in got[1]] == [2] and [len(r) for r in got[2]] == [2, 3] and [len(r) for r in got[3]] == [2]


def test_write_and_read_with_types(spark, tmp_path):
    df = spark.createDataFrame([(1, "01"), (2, "2x")], "id long, code string")
    files.write(df, "csv", str(tmp_path / "t"))
    assert sorted(r["code"] for r in files.read(spark, "csv", str(tmp_path / "t"), schema="id long, code string").collect()) == ["01", "2x"]
    with pytest.raises(ValueError):
        files.write(df, "geojson", str(tmp_path / "u"))


def test_dates(spark):
    from lattix.operators import calculators

    rows = ["2020-02-03", "2020-02-03 04:05:06", "2/3/49", "2/3/50", "12/31/1999 12:00:00 PM", "23:59", " 2020/01/02 ", "soon", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string")
    got = [r["d"] for r in calculators.parse_dates(df, "t", "d").orderBy("i").collect()]
    assert got == [20200203000000, 20200203040506, 20490203000000, 19500203000000, 19991231120000, 235900, 20200102000000, None, None, None]
    assert not calculators.is_date_column(df, "t") and calculators.is_date_column(df.where("i < 7 or i > 7"), "t")


def test_selections_and_order(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i), "x" if i == 4 else str(i)) for i in range(10)], "id long, v double, w string")
    a, b = (table.select_random(d, "id", 4).where("selected").select("id").orderBy("id").collect() for d in (df, df.repartition(5)))
    assert len(a) == 4 and a == b
    assert table.select_undefined(df, "v").where("selected").count() == 6 and table.clear(table.select_undefined(df, "v")).where("selected").count() == 0
    assert table.points_from_table(df, "id", "w").count() == 9
    with pytest.raises(ValueError):
        table.merge_by_order(df, df.limit(3), "id", "id")
    both = table.merge_by_order(df, df, "id", "id").collect()
    assert len(both) == 10 and all(r["id"] == r["id_right"] for r in both)
    counts = spark.createDataFrame([(1, 3), (2, None)], "id long, count long")
    assert not table.double_counted(counts, df) and table.double_counted(counts, df.limit(2))


def test_multivariate_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(size=(40, 4)), rng.normal(size=(1, 4)) + 50, rng.normal(size=(3, 4)).repeat(2, axis=0)]
    obs = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)] + [(99, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")
    for kind, p in (("euclidean", 2), ("manhattan", 1)):
        d = (np.abs(v[:, None] - v[None]) ** p).sum(axis=2) ** (1 / p)
        near = {(r["src"], r["dst"]) for r in weights.multivariate_pairs(obs, "id", list("abcd"), 1.5, kind).collect()}
        assert near == {(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and d[i, j] <= 1.5}
        got = {(r["src"], r["rank"]): r["dst"] for r in weights.multivariate_knn(obs, "id", list("abcd"), 3, kind).collect()}
        for i in range(len(v)):
            order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (d[i, j], j))[:3]
            assert [d[i, got[i, r]] for r in (1, 2, 3)] == pytest.approx([d[i, j] for j in order])


def test_centroid_of_a_square_with_a_hole(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    rows = [(1, [ring(outer)]), (2, [ring(outer), ring(hole)]), (3, [ring([(1, 1), (2, 2)])]), (4, [])]
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x:double,y:double>>>")
    got = {r["id"]: (r["area"], r["x"], r["y"]) for r in table.centroids(df, "id").collect()}
    assert got[1] == (16.0, 2.0, 2.0) and got[2] == (12.0, pytest.approx(28 / 12), pytest.approx(28 / 12))
    assert got[3][1:] == (None, None) and got[4][1:] == (None, None)


@pytest.mark.parametrize("statistic", ["g"])
def test_permutations_do_not_cost_their_product_with_the_neighbours(spark, statistic):
    import time

    n = 1200
    obs = spark.range(n).select("id", F.lit(1).alias("block"), (F.col("id") * 7 % 11 > 4).cast("double").alias("v"))
    start = time.time()
    got = autocorr.permute(obs, "id", "v", weights.block_weights(obs, "id", "block"), 19_999, statistic=statistic).collect()
    assert len(got) == n and time.time() - start < 45


@pytest.mark.parametrize("kind", ["lag", "error"])
def test_likelihood_models_of_many_rows_by_parts(spark, kind):
    df = spark.range(5100).select("id", (F.col("id") / 3).cast("long").alias("block"), (F.col("id") * 7 % 13).cast("double").alias("x"))
    df = df.withColumn("y", 1 + 2 * F.col("x") + F.col("block") * 5 % 17)
    got = regression.ml_model(df, "id", "y", ["x"], weights.block_weights(df, "id", "block"), kind)
    assert got["n"] == 5100 and got["lr_test"] > 0
    assert kind == "lag" or abs(got["beta"][1] - 2) < 0.05


@pytest.mark.parametrize("kind", ["lag", "error"])
def test_likelihood_models_hold_like_places_as_one(spark, kind):
    """Rows scaled apart are standardized to the same weights, but no two places are alike in them."""
    from lattix.operators import geometry

    df = spark.range(124).select("id", (F.col("id") % 30 % 6).cast("double").alias("x"), (F.col("id") % 30 / 6).cast("long").cast("double").alias("y"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    df = df.withColumn("z", 1 + 2 * F.col("v") + F.col("id") * 5 % 17 + F.col("id") % 30)
    w = geometry.voronoi_weights(df, "id").where("src < 120 and dst < 120").unionByName(spark.createDataFrame([(120, 121, 1.0), (121, 120, 1.0), (122, 0, 1.0), (0, 122, 1.0)], "src long, dst long, weight double"))
    few, whole = (regression._blocks(df, "id", "z", ["v"], e)[2] for e in (w, w.withColumn("weight", F.col("weight") * (1 + F.col("src") % 3))))
    assert sorted(len(p.matrix) for p in few) == [1, 32] and sorted(len(p.matrix) for p in whole) == [2, 121]
    got, want = (regression.ml_model(df, "id", "z", ["v"], e, kind) for e in (w, w.withColumn("weight", F.col("weight") * (1 + F.col("src") % 3))))
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-8) for k in want)
