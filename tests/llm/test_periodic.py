"""Runs and collapsed texts against a quadratic version; extensions against direct comparison."""

import hashlib
import zlib

import numpy as np
import pytest

from tillpoint.llm import periodic as P
from tillpoint.llm import queries


def brute(words):
    """[(start, length, period)] by trying every period at every place."""
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in out.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_cover():
    assert {(b - a) % P.COVER for a in P.MEMBERS for b in P.MEMBERS} == set(range(P.COVER))


@pytest.mark.parametrize("kind", range(6))
def test_extensions(kind):
    g = np.random.default_rng(kind)
    n = [5, 40, 300, 700, 700, 1000][kind]
    w = [g.integers(1, 3, n), g.integers(1, 4, n), np.ones(n, int), np.tile(g.integers(1, 3, 70), 10),
         np.concatenate([np.tile([1, 2, 3], 200), g.integers(1, 3, 100)]), np.tile(g.integers(1, 9, 250), 4)][kind]
    w = np.append(w, w.max() + 1).astype(np.int64)
    e = P.Extensions(w)
    i, j = g.integers(0, len(w), 3000), g.integers(0, len(w), 3000)
    i, j = i[i != j], j[i != j]

    def direct(a, b):
        k = 0
        while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
            k += 1
        return k

    assert e.common(i, j).tolist() == [direct(a, b) for a, b in zip(i.tolist(), j.tolist())]


def random_texts(g, count):
    texts = []
    for _ in range(count):
        words = []
        while len(words) < g.integers(0, 120):
            unit = [f"w{x}" for x in g.integers(0, g.integers(1, 6), g.integers(1, 9))]
            words += unit * int(g.integers(1, 9))
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_texts(seed):
    texts = random_texts(np.random.default_rng(seed), 150) + [["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], []]
    number = {}
    ids = np.array([number.setdefault(w, len(number) + 1) for t in texts for w in t], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = P.find(ids, first)
    assert list(zip(*(x.tolist() for x in got))) == [(d, *r) for d, t in enumerate(texts) for r in brute(t)]


def test_long_text_alone():
    g = np.random.default_rng(8)
    words = g.integers(1, 50, 30_000)
    words[2_000:10_000] = np.tile(words[2_000:3_600], 5)
    words[15_000:25_000] = np.tile([3, 4, 4], 3_334)[:10_000]
    words[10_000] = 99
    got = set(zip(*(x.tolist() for x in P.find(words.astype(np.uint64), np.array([0, 30_000]))[1:])))
    assert any(p == 1600 and s <= 2_000 and s + n == 10_000 for s, n, p in got)
    assert any(p == 3 and n >= 10_000 for s, n, p in got)


def test_hash_collisions_do_not_join_words():
    data = np.frombuffer(b"aa bb aa", np.uint8)
    ids = P.exact_ids(data, np.array([0, 3, 6]), np.array([2, 5, 8]), np.array([7, 7, 7], np.uint64))
    assert ids[0] == ids[2] != ids[1]


def test_words_longer_than_a_piece():
    data = np.frombuffer(b"x" * (P.LONG_WORD + 5) + b" a " + b"x" * (P.LONG_WORD + 5) + b" a", np.uint8)
    start, end, hashes, first = P.Words(P.T.SpanHasher()).of(data, np.array([0, len(data)]))
    assert len(start) == 4 and hashes[0] == hashes[2] and hashes[1] == hashes[3] and first.tolist() == [0, 4]


def expected(i, text):
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute(words)
    best = min(((-length, s, p) for s, length, p in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (str(i), len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(collapsed(words, runs)))


def key(r):
    return str(r)


def rows_of(df):
    return sorted(((str(r.doc_id), r.n_runs, r.start, r["length"], r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
                   for r in df.collect()), key=key)


def write(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_query_on_odd_rows_against_brute_force(frame, spark, tmp_path):
    g = np.random.default_rng(3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (5, "same text here"), (5, "same text here"), (6, "same text here"),
            (None, "no id " * 9), (None, None), (7, "ünïcode ☃ 日本語   x\u00a0y " * 5), (8, "%%% 12345 ..."), (-9, "Ω"),
            (10, "word " * 800), (11, "a\tb\r\n" * 7 + "c")]
    rows += [(100 + i, "\n".join(t)) for i, t in enumerate(random_texts(g, 120))]
    rows += [(300 + i, " ".join(f"u{x}" for x in range(i))) for i in range(60)]  # tails repeated by the rule
    d = write(frame(rows, ["w", "runs", "best", "start", "n"]), tmp_path)
    assert rows_of(queries.op13(spark, d)) == sorted((expected(i, t) for i, t in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_empty_table(frame, spark, tmp_path):
    assert queries.op13(spark, write(frame([]), tmp_path)).collect() == []


def test_outputs_are_texts_and_spans(frame):
    got = P.collapse(frame([(1, "x a b a b a b a b y")])).first()
    assert got.n_words == 10 and [tuple(r) for r in got.runs] == [(1, 8, 2)] and got.collapsed == "x a b y"
