"""Counts against plain Python, estimation against the same algorithm in numpy."""

import re
from collections import Counter

import numpy as np

from conftest import SMALL  # noqa: F401
from tillpoint.llm import quality as Q


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    marked = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def same_counts(df):
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS), r.base_failed) for r in Q.judge(df).collect())
    want = []
    for r in df.select("doc_id", "text").collect():
        n = counts(r.text)
        want.append((str(r.doc_id), *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert got == sorted(want)


def test_counts_of_documents(documents):
    same_counts(documents)


def test_counts_of_odd_rows(odd, frame):
    same_counts(odd)
    same_counts(frame([(1, "a b c a b c"), (2, "a a a a"), (3, "x\n\nx\n x\n \nx y\nx y"), (4, "a b c d a b c x b c d"),
                       (5, "a b c d e"), (6, "a b"), (7, "\x0ba\x0cb\rc a b c z q a b c")]))


def test_empty_table(frame):
    assert Q.judge(frame([])).collect() == []


def em(patterns, n, rounds):
    v = np.array([p for p, _ in patterns]) + 1
    w = np.array([c for _, c in patterns], float)
    prior = Q.PRIOR
    theta = np.array([[[Q.TRUST, .1, .9 - Q.TRUST]] * n, [[.9 - Q.TRUST, .1, Q.TRUST]] * n])

    def post():
        like = np.log(theta)[:, np.arange(n)[None], v].sum(axis=2)
        return 1 / (1 + np.exp(np.log(1 - prior) - np.log(prior) + like[0] - like[1]))
    for _ in range(rounds):
        g = w * post()
        for c, m in ((0, w - g), (1, g)):
            for k in range(3):
                theta[c, :, k] = (1 + ((v == k) * m[:, None]).sum(axis=0)) / (3 + m.sum())
        prior = (1 + g.sum()) / (2 + w.sum())
    return prior, theta


def test_estimate_equals_numpy(spark):
    rng = np.random.default_rng(1)
    seen = Counter(tuple(int(x) for x in rng.integers(-1, 2, 4)) for _ in range(300))
    df = spark.createDataFrame([(list(p), c) for p, c in seen.items()], "v array<int>, n long")
    got = Q.estimate(df, 4, rounds=7).first()
    prior, theta = em(sorted(seen.items()), 4, 7)
    assert abs(got.prior - prior) < 1e-9 and np.allclose(np.array(got.theta), theta)


def test_good_documents_stay_and_bad_ones_go(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.judge(spark.read.parquet(f"{d}/documents.parquet")).drop("quality").join(labels, "doc_id").where("not base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.1
