"""Held-out accuracy, lookup tables against the plain convolution, and odd inputs."""

import numpy as np
import pyarrow as pa

from conftest import SMALL  # noqa: F401
from tillpoint.llm import langid as L
from tillpoint.llm.queries import op8


def net(seed=0, c=3):
    rng = np.random.default_rng(seed)
    r = lambda *s: rng.standard_normal(s).astype(np.float32)
    return L.ByteNet([f"l{i}" for i in range(c)], r(256, L.EMBEDDING), [r(w, L.EMBEDDING, L.FILTERS) for w in L.WIDTHS],
                     [r(L.FILTERS) for _ in L.WIDTHS], r(L.FILTERS * len(L.WIDTHS), c), r(c))


def plain(n, text):
    """Mean window probabilities, by the definition of the network."""
    raw, total, size = text.encode(), 0, 0
    for a in range(0, len(raw), L.WINDOW):
        w = raw[a:a + L.WINDOW]
        e = n.embedding[np.frombuffer(w.ljust(L.WINDOW, b"\0"), np.uint8)]
        pooled = [max(float((e[p:p + len(bank)] * bank[:, :, k]).sum()) + float(bias[k]) for p in range(L.WINDOW - len(bank) + 1))
                  for bank, bias in zip(n.filters, n.biases) for k in range(bank.shape[2])]
        z = np.maximum(pooled, 0) @ n.out + n.out_bias
        p = np.exp(z - z.max())
        total, size = total + p / p.sum() * len(w), size + len(w)
    return total / size


def test_tables_equal_the_plain_network():
    n = net()
    texts = ["a", "hello world " * 40, "é" * 200, "x" * 256, "y" * 257]
    langs, scores = L._predict(pa.array(texts + [None, "", "123 ..."]), L.Scorer(n))
    for t, lang, s in zip(texts, langs, scores):
        p = plain(n, t)
        assert lang == n.languages[int(p.argmax())] and abs(s - p.max()) < 1e-4
    assert langs[-3:] == ["und"] * 3 and scores[-3:] == [0.0] * 3


def test_gradients_fit_a_separable_set():
    rng = np.random.default_rng(1)
    words = {"aa": ["foo", "bar"], "bb": ["oof", "rab"]}
    samples = [(k, " ".join(rng.choice(v, 40)).encode()) for k, v in words.items() for _ in range(60)]
    n = L.train(samples, epochs=6)
    langs, _ = L._predict(pa.array([s.decode() for _, s in samples]), L.Scorer(n))
    assert np.mean([a == b for a, (b, _) in zip(langs, samples)]) > 0.95


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op8(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_odd_rows(spark, odd, frame):
    n = net()
    got = {(str(r.doc_id), r.lang_pred == "und") for r in L.predict(odd, n).collect()}
    assert ("1", True) in got and ("2", True) in got and ("8", True) in got and ("-9", False) in got and ("None", False) in got
    kept = L.keep_identified(odd, n, min_score=0.0)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["-9", "4", "5", "5", "6", "7", "None"]
    assert {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"}
    assert L.keep_identified(odd, None).count() == 7
    assert L.predict(frame([]), n).collect() == []


def test_training_without_labels(spark, frame):
    assert L.fit(frame([(1, "text")]).selectExpr("*", "cast(null as string) as lang")) is None
    assert L.fit(frame([(1, None), (2, "")]).selectExpr("*", "'en' as lang")) is None
    one = L.fit(frame([(1, "only one")]).selectExpr("*", "'en' as lang"))
    assert one.languages == ["en"]


def test_sample_is_bounded(spark, documents):
    got = L.sample(documents, "doc_id", "text", "lang", per_language=3, windows_each=2)
    assert 0 < len(got) <= 2 * 3 * 2 * 4 and all(len(w) <= L.WINDOW for _, w in got)
