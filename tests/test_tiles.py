"""The pieces of grid DBSCAN: neighbour search in tiles, and the descent for the closest points of two groups."""

import numpy as np
import pandas as pd
import pytest

from brute import dbscan_brute
from tillpoint.cluster import tiles
from tillpoint.cluster.components import connected_components
from tillpoint.cluster.dbscan import closest_within, dbscan


@pytest.mark.parametrize("d,reach", [(1, 2), (2, 2), (3, 3), (4, 3)])
def test_near_meets_every_cell_within_reach(d, reach):
    rng = np.random.default_rng(d)
    cells = rng.integers(-9, 9, (400, d))
    got = set()
    for q, i in tiles.Near(cells, reach).meet(cells):
        got |= set(zip(q.tolist(), i.tolist()))
    want = {(a, b) for a in range(400) for b in np.flatnonzero((abs(cells - cells[a]) <= reach).all(1)).tolist()}
    assert want <= got
    assert all((abs(cells[a] // reach - cells[b] // reach) <= 1).all() for a, b in got)


def test_near_of_nothing():
    none = np.zeros((0, 2), np.int64)
    assert list(tiles.Near(none, 2).meet(np.zeros((3, 2), np.int64))) == []
    assert list(tiles.Near(np.zeros((3, 2), np.int64), 2).meet(none)) == []


def test_work_grows_with_occupied_neighbours():
    far_apart = np.arange(500)[:, None] * np.array([[50, 70, 90, 110]])
    assert sum(len(q) for q, _ in tiles.Near(far_apart, 3).meet(far_apart)) == 500  # each meets itself alone


def test_unite():
    label = tiles.unite(np.arange(8), np.array([7, 5, 3, 1]), np.array([5, 3, 7, 0]))
    assert label.tolist() == [0, 0, 2, 3, 4, 3, 6, 3]


def groups(spark, a, b):
    pdf = pd.DataFrame(np.concatenate([a, b]), columns=[f"x{i}" for i in range(a.shape[1])])
    pdf["pid"] = np.arange(len(pdf))
    pdf["node"] = np.where(pdf.pid < len(a), 0, len(a))
    return spark.createDataFrame([(0, len(a))], "a long, b long"), spark.createDataFrame(pdf).repartition(8)


@pytest.mark.parametrize("d", [2, 3])
def test_two_cells_of_twenty_thousand_points(spark, d):
    rng = np.random.default_rng(d)
    a, b = rng.random((20_000, d)) * 0.1, rng.random((20_000, d)) * 0.1 + np.eye(d)[0] * 0.5
    least = min(((a[i:i + 500, None, 0] - b[None, :, 0]) ** 2 + sum((a[i:i + 500, None, k] - b[None, :, k]) ** 2 for k in range(1, d))).min()
                for i in range(0, 20_000, 500)) ** 0.5
    pairs, points = groups(spark, a, b)
    assert closest_within(pairs, points, [], d, least * (1 + 1e-9)).count() == 1
    assert closest_within(pairs, points, [], d, least * (1 - 1e-9)).count() == 0


def test_descent_compares_repeated_and_single_points(spark):
    a, b = np.array([[0.0, 0.0]] * 3 + [[0.1, 0.2]]), np.array([[0.6, 0.0], [0.6, 0.0], [0.7, 0.1]])
    pairs, points = groups(spark, a, b)
    assert closest_within(pairs, points, [], 2, 0.53, direct=1).count() == 0
    assert closest_within(pairs, points, [], 2, 0.54, direct=1).count() == 1


@pytest.mark.parametrize("d,eps,ms,seed", [(4, 0.5, 4, 1), (1, 0.05, 3, 2), (3, 0.25, 6, 3)])
def test_dbscan_equals_brute_force_with_light_cells(spark, d, eps, ms, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.25, size=(90, d)) for c in (0, 1.2)] + [rng.uniform(-2, 4, size=(90, d))])
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    pdf["row_idx"] = np.arange(len(pdf))
    got = dbscan(spark.createDataFrame(pdf), [f"f{i}" for i in range(d)], eps, ms).toPandas().sort_values("row_idx")["Cluster"].to_numpy()
    assert (got == dbscan_brute(x, eps, ms)).all()


def test_dbscan_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "tile_width", lambda d, reach, cells=0: 2 * reach)
    rng = np.random.default_rng(6)
    x = np.round(rng.uniform(0, 6, size=(500, 2)), 2)
    pdf = pd.DataFrame(x, columns=["f0", "f1"])
    pdf["row_idx"] = np.arange(len(pdf))
    got = dbscan(spark.createDataFrame(pdf), ["f0", "f1"], 0.33, 4).toPandas().sort_values("row_idx")["Cluster"].to_numpy()
    assert (got == dbscan_brute(x, 0.33, 4)).all()
    assert len(set(got)) > 3


def test_components_of_paths_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (200, 150)]
    got = dict((r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    stars = spark.createDataFrame([(5, 1), (4, 1), (9, 2)], "u long, v long")
    assert {(r.node, r.component) for r in connected_components(stars).collect()} == {(5, 1), (4, 1), (1, 1), (9, 2), (2, 2)}
    none = spark.createDataFrame([], "u long, v long")
    nodes = spark.createDataFrame([(3,)], "node long")
    assert [tuple(r) for r in connected_components(none, nodes).collect()] == [(3, 3)]
