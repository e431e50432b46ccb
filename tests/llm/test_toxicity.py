"""Nearest examples against all cosines; held-out quality; odd inputs."""

import numpy as np

from conftest import SMALL  # noqa: F401
from tillpoint.llm import toxicity as T
from tillpoint.llm.queries import op7


def example_index(rng, n=400, terms=30):
    words = [f"w{i}".encode() for i in range(terms)]
    rows = []
    for i in range(n):
        k = rng.integers(0, 6)
        rows.append((i * 3, int(rng.random() < 0.4), {words[t]: int(rng.integers(1, 5)) for t in rng.integers(0, terms, k)}))
    return T.build(rows, words, 0.2), rows


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    index, rows = example_index(rng)
    v = np.zeros((len(rows), len(index.terms)))
    for i, (_, _, c) in enumerate(sorted(rows)):
        for t, n in c.items():
            v[i, index.terms.index(t)] = n
    unit = index.unit(v)
    q = index.unit(rng.integers(0, 3, (200, len(index.terms))) * (rng.random((200, len(index.terms))) < 0.15))
    for k in (1, 5, 15):
        best, sims = index.nearest(q, k)
        every = np.round(q @ unit.T, 12)
        for i in range(len(q)):
            order = sorted(range(len(rows)), key=lambda j: (-every[i, j], j))[:k]
            want = [j for j in order if every[i, j] > 0]
            assert best[i][best[i] >= 0].tolist() == want
            assert np.allclose(sims[i][:len(want)], every[i, want])
    best, _ = index.nearest(unit[:50], 5, without=np.arange(50))
    assert all(i not in best[i] for i in range(50))


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x, w = rng.random(300), rng.random(300) + 0.1
    y = (rng.random(300) < x).astype(float)
    at, mean = T.isotonic(x, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(mean) > 0).all()


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    rows = op7(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.05
    assert abs(rows.score.mean() - rows.toxic.mean()) < 0.05
    hit = toxic[toxic.predicted == 1].iloc[0]
    assert len(hit.evidence_ids) == len(hit.evidence_sims) == len(hit.evidence_toxic) > 0


def test_odd_rows_and_tables(spark, odd, frame):
    docs = frame([(i, f"a b c {'mean' if i % 2 else 'kind'} words x{i}") for i in range(60)] + [(1, "mean again"), (None, "mean")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    index = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, index).collect()}
    assert got[3] > 0.8 and got[4] < 0.2
    for rows in (T.score(odd, index), T.score(odd, T.fit(odd, labels)), T.score(odd, T.fit(docs, labels.where("false")))):
        assert rows.count() == odd.count() and all(0 <= r.score <= 1 for r in rows.collect())
    one = T.fit(docs, labels.where("toxic = 1"))
    assert all(r.score > 0.9 for r in T.score(docs, one).collect())
    assert T.score(frame([]), index).collect() == []
    assert {r.score for r in T.score(docs, T.fit(docs, labels.where("false"))).collect()} == {0.0}


def test_rare_words_of_the_examples_are_indexed(frame, spark):
    docs = frame([(i, f"plain filler text {i}" + (f" slur{i // 2}" if i < 8 else "")) for i in range(60)]
                 + [(100 + i, f"other words slur{i}") for i in range(4)] + [(200, "other words here")])
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    for i in range(4):  # each such word is in two examples only
        assert sorted(got[100 + i].evidence_ids) == [2 * i, 2 * i + 1] and got[100 + i].score > got[200].score
    assert got[200].evidence_ids == []


def test_document_frequencies_are_of_all_documents(frame):
    docs = frame([(1, "a b a"), (2, "A c"), (3, None), (4, "b"), (4, "a")])
    keys = np.sort(np.array([T.SpanHasher(lower=True).of(w) for w in (b"a", b"b", b"z")], np.uint64))
    df, n = T.document_frequencies(docs, keys)
    want = {T.SpanHasher(lower=True).of(w): k for w, k in ((b"a", 3), (b"b", 2), (b"z", 0))}
    assert n == 5 and df.tolist() == [want[int(k)] for k in keys]


def test_score_equals_the_definition(monkeypatch):
    """Search, votes and calibration from dense vectors, one text at a time."""
    rng = np.random.default_rng(7)
    index, rows = example_index(rng, n=150, terms=20)
    toxic = np.array([r[1] for r in rows], float)
    v = np.zeros((150, 20))
    for i, (_, _, counts) in enumerate(rows):
        for t, n in counts.items():
            v[i, index.terms.index(t)] = 1 + np.log(n)
    has = v > 0
    v *= np.log(151 / (1 + has.sum(axis=0))) + 1
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    share, in1, in0 = has.mean(axis=0), has[toxic == 1].mean(axis=0), has[toxic == 0].mean(axis=0)
    n1, n0 = toxic.sum(), 150 - toxic.sum()
    chi = (in1 - in0) ** 2 / (share * (1 - share) * (1 / n1 + 1 / n0))
    count = np.where(toxic == 1, 0.2 / toxic.mean(), 0.8 / (1 - toxic.mean()))

    def raw(q, without=None):
        near = sorted((-round(float(q @ v[i]), 12), i) for i in range(150) if i != without and round(float(q @ v[i]), 12) > 0)[:15]
        w = [(count[i] * (q * v[i] * chi).sum(), toxic[i]) for _, i in near]
        return (sum(a * t for a, t in w) + 0.2) / (sum(a for a, _ in w) + 1)

    some = has.any(axis=1)
    steps = T.isotonic(np.array([raw(v[i], i) for i in range(150) if some[i]]), toxic[some], count[some] + 1e-12)
    monkeypatch.setattr(T, "AT_ONCE", 100)
    doc, term = np.nonzero(rng.random((80, 20)) < 0.2)
    tf = T.Terms(80, doc, term, rng.integers(1, 4, len(doc)).astype(float))
    q = index.unit_terms(tf)
    best, _ = index.nearest(q)
    got = index.calibrated(index.raw(best, index.votes(q, best)), np.bincount(doc, minlength=80) == 0)
    for d in range(80):
        dense = np.zeros(20)
        dense[q.term[q.doc == d]] = q.value[q.doc == d]
        want = np.interp(raw(dense), *steps) if dense.any() else count[~some] @ toxic[~some] / count[~some].sum()
        assert abs(got[d] - want) < 1e-6


def test_blocks_are_pruned(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    index = T.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    texts = docs.where("doc_id % 10 = 3").select("text").toArrow().column(0).combine_chunks()
    index.opened[:] = 0
    for tf in T.known_terms(texts, T.SpanHasher(lower=True), index.keys):
        index.nearest(index.unit_terms(tf))
    opened, blocks = index.opened
    assert blocks and opened / blocks < 0.6, opened / blocks
    print("opened share", opened / blocks)
