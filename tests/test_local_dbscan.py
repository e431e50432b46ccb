"""DBSCAN of whole batches in one task each: the labels of the grid over all tasks, and rows found again by name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from test_scale_rules import _sales_tables
from tillpoint.cluster import batched, dbscan as module
from tillpoint.cluster.dbscan import dbscan
from tillpoint.cluster.local import dbscan_group
from tillpoint.sources.sales import COPIES, LINE, ROW_NAME, SALES_COLUMNS, SHORT_KEYS, sales_from_tables, sales_lines


def _brute(x, pos, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label, n = np.arange(len(x)), len(x)
    while True:
        new = np.where(core, np.where(near & core[:, None] & core[None], label[None], n).min(1), label)
        if (new == label).all():
            break
        label = new
    first = {c: pos[core & (label == c)].min() for c in np.unique(label[core])}
    number = {c: i for i, c in enumerate(sorted(first, key=first.get))}
    return np.array([number[label[i]] if core[i] else min([number[label[j]] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(n)])


@pytest.mark.parametrize("seed", range(12))
def test_a_group_in_one_task_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    d, n = 1 + seed % 4, int(rng.integers(1, 400))
    x = rng.normal(size=(n, d)) * rng.choice([0.3, 1.0, 3.0])
    if seed % 3 == 0:
        x = np.round(x, 1)
    pos = rng.permutation(n) * 3
    for eps, least in ((0.1, 3), (0.33, 5), (1.0, 8)):
        assert (dbscan_group(x, pos, eps, least) == _brute(x, pos, eps, least)).all()


def test_large_cells_meet_by_their_points():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 0.2, (3000, 2)), rng.uniform(0, 0.2, (3000, 2))
    for gap, clusters in ((0.42, 1), (0.75, 2)):
        x = np.concatenate([a, b + [gap, 0.0]])
        assert dbscan_group(x, np.arange(len(x)), 0.5, 5).max() + 1 == clusters


def test_batches_in_tasks_are_the_grid_over_all(spark, monkeypatch):
    rows = spark.range(900).select((F.hash("id") % 9).cast("int").alias("Quantity"), (F.hash(F.col("id") + 7) % 11 * 0.5).alias("UnitPrice"),
                                   (F.hash(F.col("id") * 3) % 40).cast("long").alias("CustomerID"), "id")
    seen = []
    cut = module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df, how="checkpoint": (seen.append(how), cut(df, how))[1])
    told = [batched.dbscan_type2(rows, ["id"], batch_size=200, eps=e, whole_batches=True).toPandas() for e in (0.3, 0.6)]
    assert seen == ["table", "table"]  # one stored result each, nothing checkpointed or cached between its steps
    for e, got in zip((0.3, 0.6), told):
        want = batched.dbscan_type2(rows, ["id"], batch_size=200, eps=e).toPandas()
        assert list(got.columns) == list(want.columns)
        assert got.sort_values("row_idx").reset_index(drop=True).equals(want.sort_values("row_idx").reset_index(drop=True)[got.columns])


def test_dbscan_keeps_keys_without_a_bound_on_the_grid(spark, monkeypatch):
    monkeypatch.setattr(module, "_by_group", lambda *a: pytest.fail("a key of unknown size in one task"))
    df = spark.range(30).select("id", F.lit(1).alias("k"), (F.col("id") * 0.1).alias("x"))
    assert dbscan(df, ["x"], 0.5, 3, "id", ["k"]).select("Cluster").distinct().collect()[0][0] == 0


def test_rows_have_names_also_where_keys_repeat(spark, tmp_path):
    d = _sales_tables(spark, tmp_path)
    extra = spark.createDataFrame([(1, "ring", 2.5), (1, "bell", 9.0)], "p_partkey long, p_name string, p_retailprice double")
    extra.coalesce(1).write.mode("append").parquet(f"{d}/part.parquet")  # part 1 three times, order 3 twice
    names = sales_lines(spark, d, [*SHORT_KEYS, *COPIES, "UnitPrice"])
    assert names.count() == sales_from_tables(spark, d).count() == names.select(*ROW_NAME).distinct().count() > 8
    beside = names.select(*ROW_NAME, F.struct("InvoiceDate", "UnitPrice").alias("mine"), F.monotonically_increasing_id().alias("n")).persist()
    wide = sales_lines(spark, d, SALES_COLUMNS, beside=beside.where("n % 2 = 0" if beside.count() > 1 else "true"))
    assert wide.columns == [*SALES_COLUMNS, "mine", "n"]
    rows = wide.collect()
    assert len(rows) == beside.where("n % 2 = 0").count() and len({r.n for r in rows}) == len(rows)
    assert all(r.mine.InvoiceDate == r.InvoiceDate and r.mine.UnitPrice == r.UnitPrice for r in rows)


def test_wide_rows_are_not_numbered_or_labelled(spark, monkeypatch):
    import __spark_entry__ as e

    seen = []
    label = batched.dbscan_type2
    monkeypatch.setattr(batched, "dbscan_type2", lambda df, *a, **b: (seen.append(df.columns), label(df, *a, **b))[1])
    out = e.queries()["dbscan_type2"](spark, SMALL)
    assert seen == [[*SHORT_KEYS, *batched.TYPE2_FEATURES, *COPIES]]
    wide = sales_from_tables(spark, SMALL)
    assert sorted(map(str, out.select(*wide.columns).collect())) == sorted(map(str, wide.where(
        "Quantity is not null and UnitPrice is not null and CustomerID is not null").collect()))
    assert out.where("BatchNumber != batch_number").isEmpty() and LINE not in out.columns
