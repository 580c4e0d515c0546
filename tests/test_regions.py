"""Regions, density trees, embeddings and shapes on small fixtures with known answers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.operators import density, geometry, regions, weights


@pytest.fixture(scope="module")
def board(spark):
    """A 6 x 6 lattice whose left and right halves differ."""
    return spark.createDataFrame([(i, i % 6, i // 6, float(i % 6 >= 3) * 10 + (i * 7 % 5) / 10, 1.0 + i % 3) for i in range(36)], "id long, gx long, gy long, v double, m double")


@pytest.fixture(scope="module")
def rook(board):
    return weights.lattice_weights(board, "id")


@pytest.fixture(scope="module")
def blobs(spark):
    """Two tight groups of 30 and 20 points and one far away."""
    rng = np.random.default_rng(3)
    p = np.vstack([rng.normal(0, 0.2, (30, 2)), rng.normal(8, 0.2, (20, 2)), [[40, -40]]])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, a double, b double")


def labels(df, key="id", column="cluster"):
    return {r[key]: r[column] for r in df.collect()}


def contiguous(found, rook) -> bool:
    near = {}
    for r in rook.collect():
        near.setdefault(r["src"], []).append(r["dst"])
    lists = [near.get(i, []) for i in range(36)]
    return all(len(regions.pieces([i for i in found if found[i] == c], lists)) == 1 for c in set(found.values()) - {0})


def halves(found) -> bool:
    return len({found[i] for i in range(36) if i % 6 < 3}) == 1 and len({found[i] for i in range(36) if i % 6 >= 3}) == 1 and len(set(found.values())) == 2


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single"])
def test_redcap_finds_halves(board, rook, method):
    assert halves(labels(regions.redcap(board, "id", ["v"], 2, rook, method)))


@pytest.mark.parametrize("method", ["greedy", "tabu", "annealing"])
def test_zones_are_contiguous(board, rook, method):
    assert halves(labels(regions.azp(board, "id", ["v"], 2, rook, method, tries=4)))
    found = labels(regions.max_p(board, "id", ["v"], rook, "m", 12.0, method, tries=3))
    mass = {r["id"]: r["m"] for r in board.collect()}
    assert contiguous(found, rook) and all(sum(mass[i] for i in found if found[i] == c) >= 12 for c in set(found.values()))


def test_zone_moves_keep_their_sums():
    x = np.arange(12.0).reshape(6, 2)
    near = [[j for j in (i - 1, i + 1) if 0 <= j < 6] for i in range(6)]
    z = regions.Zones(x, near, np.array([1, 1, 1, 2, 2, 2]), np.ones(6), 1)
    before, change = z.cost(), z.change(2, 2)
    z.move(2, 2)
    direct = sum(((x[m] - x[m].mean(axis=0)) ** 2).sum() for m in ([0, 1], [2, 3, 4, 5]))
    assert z.cost() == pytest.approx(before + change) == pytest.approx(direct)


def test_floor_out_of_reach_leaves_zero(board, rook):
    assert set(labels(regions.max_p(board, "id", ["v"], rook, None, 100.0, tries=2)).values()) == {0}


def test_too_few_zones_for_islands(spark, board):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    with pytest.raises(Exception, match="unconnected"):
        regions.azp(board, "id", ["v"], 2, none, tries=1).collect()


def test_spatial_kmeans_is_contiguous(board, rook):
    mixed = board.withColumn("c", (F.col("id") % 4).cast("int"))
    assert contiguous(labels(regions.make_spatial(mixed, "id", "c", ["v"], rook)), rook)
    assert halves(labels(regions.spatial_kmeans(board, "id", ["v"], 2, rook)))


def test_density_tree(blobs):
    rows = {r["id"]: r for r in density.hdbscan(blobs, "id", ["a", "b"], least=8, min_points=4).collect()}
    assert {rows[i]["cluster"] for i in range(30)} == {1} and {rows[i]["cluster"] for i in range(30, 50)} == {2} and rows[50]["cluster"] == -1
    assert rows[50]["probability"] == 0 and rows[50]["outlier"] == max(r["outlier"] for r in rows.values())
    assert all(0 <= r["probability"] <= 1 and 0 <= r["outlier"] <= 1 for r in rows.values())


def test_repeated_points_and_empty_tables(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(12)], "id long, a double, b double")
    assert density.hdbscan(same, "id", ["a", "b"], least=3).count() == 12
    assert density.kmedoids(same, "id", ["a", "b"], 3).count() == 12
    none = same.where("false")
    for f in (density.hdbscan, density.smacof, density.tsne):
        out = f(none, "id", ["a", "b"])
        assert (out[0] if isinstance(out, tuple) else out).count() == 0
    for m in ("pam", "clara", "clarans"):
        assert density.kmedoids(none, "id", ["a", "b"], 3, m).count() == 0
    assert density.spectral(none, "id", ["a", "b"], 2).count() == 0
    assert geometry.voronoi_weights(none, "id", x="a", y="b").count() == 0


def test_medoids_against_all_choices():
    d = density.distances(np.random.default_rng(5).normal(size=(14, 2)), "manhattan")
    _, cost = density.swap_medoids(d, density.build_medoids(d, 3))
    best = min(d[:, list(c)].min(axis=1).sum() for c in combinations(range(14), 3))
    assert best - 1e-9 <= cost <= best * 1.05


@pytest.mark.parametrize("method", ["pam", "clara", "clarans"])
def test_medoids_split_groups(blobs, method):
    found = labels(density.kmedoids(blobs.where("id < 50"), "id", ["a", "b"], 2, method))
    assert {found[i] for i in range(30)} == {1} and {found[i] for i in range(30, 50)} == {2}


@pytest.mark.parametrize("affinity", ["gaussian", "knn", "mutual"])
def test_spectral_splits_groups(blobs, affinity):
    found = labels(density.spectral(blobs.where("id < 50"), "id", ["a", "b"], 2, affinity))
    assert {found[i] for i in range(30)} == {1} and {found[i] for i in range(30, 50)} == {2}


def test_embeddings(blobs):
    d = blobs.where("id < 50")
    _, stress = density.smacof(d, "id", ["a", "b"])
    assert stress < 1e-3
    p = {r["id"]: np.array([r["dim1"], r["dim2"]]) for r in density.tsne(d, "id", ["a", "b"], perplexity=10, rounds=400).collect()}
    near = [min((j for j in p if j != i), key=lambda j: ((p[i] - p[j]) ** 2).sum()) for i in range(50)]
    assert all((i < 30) == (j < 30) for i, j in enumerate(near))


def test_spanning_tree_against_all_edges(spark):
    p = np.random.default_rng(8).random((20, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, x double, y double")
    d, root, total = density.distances(p), list(range(20)), 0.0
    for w, i, j in sorted((d[i, j], i, j) for i, j in combinations(range(20), 2)):
        if root[i] != root[j]:
            total += w
            root = [root[i] if r == root[j] else r for r in root]
    edges = {(r["src"], r["dst"]) for r in density.spanning_weights(df, "id").collect()}
    assert len(edges) == 38 and sum(d[a, b] for a, b in edges) / 2 == pytest.approx(total)


def test_triangles_have_empty_circles():
    p = np.random.default_rng(2).random((40, 2))
    tri, centre = geometry.triangulate(p)
    for t, c in zip(tri, centre):
        if t.max() < 40:
            r = np.hypot(*(p[t[0]] - c))
            assert (np.hypot(*(p - c).T) >= r - 1e-9).all()


def test_cells_cover_the_box(spark):
    p = np.random.default_rng(4).random((30, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(30, float(p[0, 0]), float(p[0, 1]))], "id long, x double, y double")
    area = 0.0
    for r in geometry.voronoi_polygons(df, "id").where("id < 30").collect():
        v = np.array([(q["x"], q["y"]) for q in r["rings"][0]])
        area += abs((v[:, 0] * np.roll(v[:, 1], -1) - np.roll(v[:, 0], -1) * v[:, 1]).sum()) / 2
    box = np.ptp(p, axis=0) + 2 * 0.02
    assert area == pytest.approx(box[0] * box[1], rel=1e-6)
    assert ((0, 30) in {(r["src"], r["dst"]) for r in geometry.voronoi_weights(df, "id").collect()})


def test_shapes_with_holes_and_empty(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    t = "id long, rings array<array<struct<x:double,y:double>>>"
    donut = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in sq(0, 10)], [(float(x), float(y)) for x, y in sq(3, 7)]])], t)
    small = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in sq(4, 5)]]), (2, [[(float(x), float(y)) for x, y in sq(1, 2)]]), (3, []), (4, None)], t)
    got = {(r["a"], r["b"]) for r in geometry.shape_pairs(small, donut, "id", "id", 2.0).collect()}
    assert got == {(2, 1)}


def test_circles_do_not_overlap(spark):
    df = spark.createDataFrame([(i, float(i % 3), float(i // 3), 1.0 + i) for i in range(9)], "id long, x double, y double, s double")
    c = geometry.circle_cartogram(df, "id", "s").collect()
    assert all(np.hypot(a["x"] - b["x"], a["y"] - b["y"]) > 0.9 * (a["radius"] + b["radius"]) for a, b in combinations(c, 2))


@pytest.fixture(scope="module")
def many(spark):
    """5,002 points, more than the former bounds of 4,000 and 5,000, in two groups far apart."""
    i = F.col("id")
    return spark.range(5002).select("id", ((i % 2) * 100 + (i / 2).cast("long") % 50 * 0.01).alias("a"), ((i / 100).cast("long") * 0.01).alias("b"))


def apart(found) -> bool:
    return len(found) == 5002 and {found[i] for i in range(0, 5002, 2)} == {1} and {found[i] for i in range(1, 5002, 2)} == {2}


def test_many_rows_scaled(many):
    from lattix.operators.cluster import classic_mds

    d = many.orderBy("id").toPandas().to_numpy()
    p = classic_mds(many, "id", ["a", "b"]).orderBy("id").toPandas().to_numpy()
    assert len(p) == 5002 and np.abs(density.distances(p[::50, 1:]) - density.distances(d[::50, 1:])).max() < 1e-6
    far = np.abs(p[:, 1:])
    assert all(p[int((far[:, j] >= far[:, j].max() * (1 - 1e-12)).argmax()), j + 1] > 0 for j in range(2))


def test_many_rows_in_pairs(many):
    assert density.distance_matrix(many, "id", ["a", "b"]).count() == 5002 * 5001


@pytest.mark.parametrize("method", ["pam", "clarans"])
def test_many_rows_around_medoids(many, method):
    assert apart(labels(density.kmedoids(many, "id", ["a", "b"], 2, method)))


@pytest.mark.parametrize("select", ["eom", "leaf"])
def test_many_rows_in_a_density_tree(many, select):
    found = labels(density.hdbscan(many, "id", ["a", "b"], least=2500, min_points=3, select=select))
    assert apart(found)


@pytest.fixture(scope="module")
def strip(spark):
    """5,002 points on a strip of two rows, at two points a place; values differ between its halves."""
    i = F.col("id")
    place = (i / 2).cast("long")
    return spark.range(5002).select("id", (place % 1251).cast("double").alias("x"), (place / 1251).cast("long").cast("double").alias("y"), (F.when(place % 1251 < 600, 0.0).otherwise(50.0) + i % 3 * 0.1).alias("v"))


def strip_halves(found) -> bool:
    left = {found[i] for i in found if i // 2 % 1251 < 600}
    right = {found[i] for i in found if i // 2 % 1251 >= 600}
    return len(found) == 5002 and len(left) == len(right) == 1 and left != right


@pytest.mark.parametrize("method", ["average", "complete", "single", "ward"])
def test_many_rows_in_redcap(strip, method):
    assert strip_halves(labels(regions.redcap(strip, "id", ["v"], 2, geometry.voronoi_weights(strip, "id"), method)))


def test_many_rows_in_contiguous_clusters(strip):
    from lattix.operators.cluster import hierarchical

    assert strip_halves(labels(hierarchical(strip, "id", ["v"], 2, "average", geometry.voronoi_weights(strip, "id"))))


def test_linkage_keeps_to_neighbours_like_the_full_matrix():
    from lattix.operators.cluster import Near, linkage

    x = np.random.default_rng(6).normal(size=(40, 2))
    a, b = np.triu_indices(40, 1)
    for method in ("single", "complete", "average", "ward"):
        full, lists = linkage(x, method), linkage(x, method, Near(40, a, b))
        assert [m[:2] for m in full] == [m[:2] for m in lists] and np.allclose([m[2] for m in full], [m[2] for m in lists])


@pytest.mark.parametrize("method", ["greedy", "tabu", "annealing"])
def test_many_rows_in_zones(strip, method):
    w = geometry.voronoi_weights(strip, "id").cache()
    for found in (labels(regions.azp(strip, "id", ["v"], 2, w, method, tries=1)), labels(regions.max_p(strip, "id", ["v"], w, None, 1500.0, method, tries=1))):
        assert len(found) == 5002 and set(found.values()) - {1, 2, 3} == set() and len(set(found.values())) >= 2
        near = {}
        for r in w.collect():
            near.setdefault(r["src"], []).append(r["dst"])
        assert all(len(regions.pieces([i for i in found if found[i] == c], near)) == 1 for c in set(found.values()))


def test_circles_that_overlap_are_all_found(spark):
    rng = np.random.default_rng(9)
    p, r = rng.random((300, 2)), rng.random(300) ** 6 * 0.2
    want = {(i, j) for i, j in combinations(range(300), 2) if np.hypot(*(p[i] - p[j])) < r[i] + r[j]}
    got = [tuple(sorted(e)) for i, j in geometry._overlaps(p, r) for e in zip(i.tolist(), j.tolist())]
    assert want <= set(got) and len(got) == len(set(got))
    many = spark.range(4100).select("id", (F.col("id") % 64).cast("double").alias("x"), (F.col("id") / 64).cast("long").cast("double").alias("y"), F.lit(1.0).alias("s"))
    assert geometry.circle_cartogram(many, "id", "s", rounds=5).count() == 4100


@pytest.fixture(scope="module")
def stacked(spark):
    """Weights of 240 points at 60 places, four at each, and their ids; values follow the place."""
    p = spark.range(240).select("id", (F.col("id") % 60 % 10).cast("double").alias("x"), (F.col("id") % 60 / 10).cast("long").cast("double").alias("y"), (F.col("id") % 60 * 37 % 60).cast("double").alias("v"))
    return p, geometry.voronoi_weights(p, "id").cache(), list(range(240))


def test_points_at_one_place_are_held_as_one(stacked):
    from lattix.operators.cluster import neighbours_of

    _, w, ids = stacked
    near, want = neighbours_of(w, ids), {i: [] for i in ids}
    for r in w.collect():
        want[r["src"]].append(r["dst"])
    assert near.kinds == 60 and len(near.to) < 60 * 9
    assert [near[i] for i in ids] == [sorted(want[i]) for i in ids]
    lone = neighbours_of(w.where("src <> 7 or dst <> 67"), ids)
    assert lone.kinds == 240 and [lone[i] for i in ids] == [sorted(want[i]) for i in ids]


@pytest.mark.parametrize("method", ["average", "complete", "single", "ward"])
def test_like_rows_merge_first(method):
    from lattix.operators.cluster import Near, _contiguous_linkage, cut_tree, linkage

    rng = np.random.default_rng(3)
    few, group = rng.normal(size=(30, 2)), np.r_[np.arange(30), rng.integers(0, 30, 60)]
    a, b = np.array([(i, j) for i in range(90) for j in range(i) if abs(group[i] - group[j]) % 28 <= 1 or (group[i] * group[j]) % 7 == 3]).T
    x = few[group]
    want = _contiguous_linkage(x, method, Near(90, a, b))
    got = linkage(x, method, Near(90, group[a], group[b], np.array([int(np.flatnonzero(group == g)[0]) for g in group])))
    assert len(got) == len(want) and np.allclose([m[2] for m in got], [m[2] for m in want])
    assert all((cut_tree(90, got, k) == cut_tree(90, want, k)).all() for k in range(1, 30))


@pytest.mark.parametrize("method", ["average", "complete", "single", "ward"])
def test_redcap_of_points_at_one_place(stacked, method):
    from lattix.operators.cluster import Near, _contiguous_linkage, partition_tree, standard_matrix

    p, w, ids = stacked
    a, b = np.array([(r["src"], r["dst"]) for r in w.collect()]).T
    x, near = standard_matrix(p, "id", ["v"])[1], Near(240, a, b)
    got = labels(regions.redcap(p, "id", ["v"], 4, w, method))
    assert len({got[i] for i in ids}) == 4 and all(got[i] == got[i % 60] for i in ids)
    if method != "ward":
        assert [got[i] for i in ids] == partition_tree(x, regions._shortest_edges(x, near, _contiguous_linkage(x, method, near)), 4).tolist()


@pytest.mark.parametrize("method", ["greedy", "tabu", "annealing"])
def test_zones_of_kinds_move_like_those_of_places(stacked, method):
    from lattix.operators.cluster import Near, neighbours_of

    _, w, ids = stacked
    a, b = np.array([(r["src"], r["dst"]) for r in w.collect()]).T
    x, kinds, places = np.random.default_rng(4).normal(size=(240, 2)), neighbours_of(w, ids), Near(240, a, b)
    label = regions._start_azp(kinds, 5, np.random.default_rng(5))
    assert set(label) == {1, 2, 3, 4, 5} and all(len(regions.pieces(np.flatnonzero(label == c).tolist(), places)) == 1 for c in range(1, 6))
    one, two = (regions.Zones(x, near, label, np.ones(240), 3.0) for near in (kinds, places))
    assert len(one.around) == 60 and list(one.moves()) == list(two.moves()) != []
    got, want = (regions.improve(z, method, np.random.default_rng(6)) for z in (one, two))
    assert got[0] == want[0] and (got[1] == want[1]).all() and (got[1] != label).any()
    assert all(len(regions.pieces(np.flatnonzero(got[1] == c).tolist(), places)) == 1 for c in set(got[1]))


def test_zones_grow_within_a_kind():
    from lattix.operators.cluster import Near

    alone = Near(5, np.zeros(0), np.zeros(0), np.array([0, 0, 2, 2, 2]))
    label = regions._start_azp(alone, 2, np.random.default_rng(1))
    assert label[0] == label[1] != label[2] == label[3] == label[4]
