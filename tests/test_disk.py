"""What queries leave on disk on their way: shares, compressed tables, released exchanges."""

import os

import pytest
from pyspark.sql import functions as F

from test_scale_rules import _sales_tables
from tillpoint.session import discard, ensure_checkpoint_dir, shuffles_released, stored
from tillpoint.sources.sales import SHARES, sales_from_tables, sales_lines


def _rows(frames):
    return sorted(str(r) for df in frames for r in df.collect())


def test_shares_are_all_lines_once(spark, tmp_path):
    d = _sales_tables(spark, tmp_path)
    assert _rows([sales_lines(spark, d, share=s) for s in range(SHARES)]) == _rows([sales_from_tables(spark, d)])


def test_float_id_csv_is_written_compressed_in_shares(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e
    from tillpoint.plans import cleaning

    d, written = _sales_tables(spark, tmp_path), []
    write = cleaning.write_csv
    monkeypatch.setattr(cleaning, "write_csv", lambda df, path, *a: (written.append(path), write(df, path, *a)))
    back = e.queries()["sales_csv_float_ids"](spark, d)
    wide = sales_from_tables(spark, d)
    # the CSV's dates have minutes, and an empty cell is a null
    assert _rows([back.drop("n_malformed").select(*wide.columns)]) == _rows([wide])
    assert back.where("n_malformed > 0").isEmpty()
    files = [f for f in os.listdir(written[0].removeprefix("file:")) if f.startswith("part-")]
    assert len(written) == SHARES and len(set(written)) == 1 and files and all(f.endswith(".csv.gz") for f in files)


def test_stored_tables_leave_no_shuffle_files(spark):
    df = spark.range(20000).withColumn("k", F.col("id") % 7).repartition(5, "k")
    table = stored(df, "test")
    assert table.schema.simpleString() == df.schema.simpleString() and table.count() == 20000 and table.agg(F.sum("id")).first()[0] == sum(range(20000))
    files = [f.removeprefix("file://") for f in table.inputFiles()]
    assert files and all(os.path.exists(f) for f in files) and ensure_checkpoint_dir(spark).removeprefix("file:") in files[0]
    discard(table)
    assert not any(os.path.exists(f) for f in files)


def test_release_is_set_only_inside(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_released(spark):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key) == before
