"""Every query with an oracle equals DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from tillpoint.sources.sales import TABLES
from tools_compare import compare

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, con, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    exp = con.sql(ORACLE[name]).df()
    assert compare(got, exp) in ("OK", "NEAR (hash differs only by rounding)")


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["Date", "Sales"]
    assert df.count() > 0
