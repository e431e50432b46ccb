"""Stage decisions against plain definitions, and the stages chained."""

import corpus_pipeline as P
from conftest import SMALL
from tillpoint.llm import langid, secretscan
from test_decontaminate import brute as windows
from test_packing import check
from test_simhash import brute as prints

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, documents):
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    net = langid.fit(documents)
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents, net).collect()}
    rows = [tuple(r) for r in documents.select(COLUMNS).collect() if said[r.doc_id][0] != "und" and said[r.doc_id][1] >= 0.4]
    least = {d: c for d, _, c in prints([r[:2] for r in rows])}
    rows = [r for r in rows if least[r[0]] == r[0]]
    hit = {d for d, _, _, _, _, bad in windows([r[:2] for r in rows], bench) if bad}
    rows = [r for r in rows if r[0] not in hit]
    texts = {}
    for r in rows:
        every = secretscan.find(r[1])[1]
        texts[r[0]] = secretscan.redacted(r[1], every, "[SECRET]") if every else r[1]

    docs = documents
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == COLUMNS, name
    assert {r.doc_id: r.text for r in docs.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    out = P.run(spark, SMALL).collect()
    check(out, texts)
    assert len(P.STAGES) == 5


def test_clean_documents_stay(spark, documents):
    kept = {r.doc_id for r in P.language(spark, documents, SMALL).collect()}
    assert len(kept) >= 0.98 * documents.where("text rlike '[a-zA-Z]'").count()


def test_odd_documents_pass_all_stages(spark, odd, frame):
    odd = odd.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "fp", "_key")
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.collect()
