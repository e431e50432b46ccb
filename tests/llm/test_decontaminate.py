"""Wu-Manber windows against a search of every window in every text."""

import hashlib
import random
import re

import pyarrow as pa

from conftest import SMALL
from tillpoint.llm import decontaminate as D
from tillpoint.llm.queries import ORACLE, op1
from tillpoint.llm.text import SpanHasher

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    patterns = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        m = min(window, len(w))
        for k in range(len(w) - m + 1):
            patterns.setdefault(tuple(w[k:k + m]), set()).add(i)
    sizes = {len(p) for p in patterns}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k:k + m])) in patterns:
                    hit.update(range(k, k + m))
                    found |= patterns[p]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def result(df):
    return [tuple(r)[:6] for r in df.collect()]


def key(rows):
    return sorted(rows, key=str)


def test_tables_equal_brute_force(spark, documents):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = result(D.decontaminate(documents, bench))
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert key(got) == key(want)
    assert any(r[5] for r in want)


def test_query_equals_duckdb(spark, con):
    got, want = op1(spark, SMALL), con.sql(ORACLE["op1_decontamination"])
    assert sorted(got.columns) == sorted(want.columns)
    assert key(map(tuple, got.select(*want.columns).collect())) == key(want.fetchall())


def test_random_texts_and_short_items():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dd", "É", "é"]
    for window in (2, 4, 10):
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(25)]
        docs = [(i, "-".join(rng.choices(vocabulary, k=rng.randint(0, 1500)))) for i in range(20)]
        sets = D.build(items, window)
        got = list(D.scan(pa.array([t for _, t in docs]), [sets], SpanHasher(lower=True)))
        want = brute(docs, items, window)
        assert [(n, h, len(i), D.digest(i)) for n, h, i in got] == [w[1:5] for w in want]


def test_blocks_of_the_benchmark_give_the_same(spark, documents):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert len(D.pattern_blocks(bench, block_bytes=2000)) > 1
    assert key(result(D.decontaminate(documents, bench, block_bytes=2000))) == key(result(D.decontaminate(documents, bench)))


def test_odd_rows_and_items(spark, odd):
    bench = spark.createDataFrame([(1, "same text"), (1, "SAME, text"), (None, "no id"), (3, None), (4, ""), (5, "日本語 x")],
                                  "item_id long, text string")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert key(result(D.decontaminate(odd, bench))) == key(brute(rows, [tuple(r) for r in bench.collect()]))
    kept = D.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    clean = [str(d) for d, *_, bad in brute(rows, [tuple(r) for r in bench.collect()]) if not bad]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(clean) and len(clean) < len(rows)


def test_empty_tables(spark, odd, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r[2] for r in result(D.decontaminate(odd, none))} == {0}
    assert result(D.decontaminate(frame([]), none)) == []
    assert D.remove_contaminated(odd, none).count() == odd.count()
