import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"

#: Rows that every operator must take: null and empty texts, a long one, repeated rows, a null id, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "same text here"), (5, "same text here"),
       (6, "same text here"), (None, "no id at all"), (7, "ünïcode ☃ 日本語   x"), (8, "%%% 12345 ..."), (-9, "Ω")]
#: Names that operators use themselves, as extra columns.
CLASHING = ["fp", "row", "bin", "score", "_text", "component_id", "lang_pred", "_key", "slot", "shard", "idx", "v", "n_chars"]


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_library(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, extra=()):
        schema = "doc_id long, text string" + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame([(*r[:2], *("x" for _ in extra)) for r in rows], schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD, CLASHING)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
