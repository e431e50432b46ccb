"""Nearest-first search in tiles, components without leaves, narrow batched rows."""

import numpy as np
import pytest

from tillpoint.cluster import batched, tiles
from tillpoint.cluster.components import components_by_leaves, connected_components
from tillpoint.operators.rowindex import with_row_index


def counted(monkeypatch):
    pairs, plain = [0], tiles.gap_far

    def gap_far(alo, *rest):
        pairs[0] += len(alo)
        return plain(alo, *rest)

    monkeypatch.setattr(tiles, "gap_far", gap_far)
    return pairs


def light(d, n, eps):
    side = eps / d ** 0.5 * (1 - 1e-9)
    x = np.random.default_rng(d).random((n, d))
    return x, np.floor(x / side).astype(np.int64), int(eps / side) + 1


@pytest.mark.parametrize("d,eps", [(2, 0.05), (4, 0.2), (7, 0.6)])
def test_settled_points_meet_no_further_cells(monkeypatch, d, eps):
    pairs = counted(monkeypatch)
    x, cell, reach = light(d, 3000, eps)
    none, no_cells = np.zeros((0, d)), np.zeros((0, d), np.int64)
    found, q, _ = tiles.count_neighbours(no_cells, none, none, np.zeros(0, np.int64), cell, x, np.ones(len(x), np.int64),
                                         np.arange(len(x)), reach, eps, 5, d)
    true = np.array([(((x - p) ** 2).sum(1) <= eps * eps).sum() for p in x])
    assert not len(q)
    assert (found[true < 5] == true[true < 5]).all() and (found[true >= 5] >= 5).all()
    if d == 4:
        assert pairs[0] < 0.1 * len(x) ** 2  # the coarse blocks held over half of all pairs


def test_cells_of_the_largest_set_look_for_no_others(monkeypatch):
    pairs = counted(monkeypatch)
    d, eps = 4, 0.3
    side = eps / (d + 3) ** 0.5 * (1 - 1e-9)
    x = np.random.default_rng(1).random((3000, d))
    x[-5:] += 3  # some far away
    cell = np.floor(x / side).astype(np.int64)
    cell, first = np.unique(cell, axis=0, return_index=True)
    x, reach = x[first], int(eps / side) + 1
    label, a, _ = tiles.link_cells(cell, x, x, np.ones(len(x), bool), reach, eps, d + 3)
    want, (i, j) = np.arange(len(x)), np.nonzero(((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps)
    assert (label == tiles.unite(want, i, j)).all() and not len(a)
    assert pairs[0] < 0.1 * len(x) ** 2


def test_components_by_leaves_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(k), int(a), int(b)) for k, a, b in zip(rng.integers(0, 2, 300), rng.integers(0, 400, 300), rng.integers(0, 400, 300))],
                                  "k int, u long, v long")
    nodes = spark.range(400).selectExpr("id AS node").crossJoin(spark.range(2).selectExpr("cast(id AS int) AS k")).select("k", "node")
    rows = [sorted(tuple(r) for r in f(edges, nodes, ["k"]).select("k", "node", "component").collect()) for f in (components_by_leaves, connected_components)]
    assert rows[0] == rows[1] and len(rows[0]) == 800


def test_row_index_keeps_only_the_named_columns(spark):
    df = spark.range(50).selectExpr("id", "id % 7 AS k", "'x' AS wide")
    out = with_row_index(df, ["k", "id"], keep=["id"])
    assert out.columns == ["id", "row_idx"]
    want = {r["id"]: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r["k"], r["id"])))}
    assert {r["id"]: r["row_idx"] for r in out.collect()} == want


def test_batched_dbscan_of_narrow_rows(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(rng.integers(1, 6)), float(rng.integers(1, 5)), int(rng.integers(1, 40)), "x") for i in range(120)],
                               "id int, Quantity int, UnitPrice double, CustomerID long, wide string")
    narrow, whole = (batched.dbscan_type2(df, ["id"], batch_size=50, keep=k) for k in ([], None))
    assert "wide" not in narrow.columns and "id" not in narrow.columns and "wide" in whole.columns
    labels = [sorted(map(tuple, d.select("batch_number", "row_idx", "Cluster").collect())) for d in (narrow, whole)]
    assert labels[0] == labels[1]
