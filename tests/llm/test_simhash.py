"""Fingerprints and components against plain definitions."""

import numpy as np
import xxhash

from tillpoint.llm import simhash as S


def fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64(" ".join(w[i:i + k]).encode(), seed=42).intdigest() for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, edges):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows, bits=3):
    """Ids may be null or repeat; null counts as the largest."""
    fps = [fingerprint(t) for _, t in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])
    least = {}
    for c, (d, _) in zip(comp, rows):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return [(d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, comp)]


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_documents_equal_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert key(S.near_duplicates(documents).collect()) == key(brute(rows))
    assert key(S.near_duplicates(documents, leaf_rows=5, leaves=64).collect()) == key(brute(rows))


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert key(S.near_duplicates(odd).collect()) == key(brute(rows))


def test_keep_one_of_each_component(odd):
    got = S.keep_one(odd)
    assert got.columns == odd.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    want = sorted({c for _, _, c in brute([tuple(r) for r in odd.select("doc_id", "text").collect()])}, key=str)
    assert ids == want


def test_one_id_on_several_texts_loses_none(frame):
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(5, words("a")), (5, words("b")), (7, words("b")), (8, words("c")), (5, words("c")), (9, words("a")), (5, words("c")),
            (None, words("d")), (None, words("d")), (None, words("a")), (3, words("e")), (3, words("f")), (3, words("e"))]
    got = sorted((str(r.doc_id), r.text) for r in S.keep_one(frame(rows, ["fp", "n", "_h1"])).collect())
    assert got == sorted([("5", words("a")), ("5", words("b")), ("5", words("c")), ("None", words("d")), ("3", words("e")), ("3", words("f"))])


def test_hot_equal_rows_keep_one(frame):
    rows = [(1, "the same row again and again")] * 900 + [(i, f"text {i} " + "x y z " * (i % 5) + f"end {i * i}") for i in range(2, 600)]
    got = sorted((r.doc_id, r.text) for r in S.keep_one(frame(rows)).collect())
    least = {}
    for (d, t), (_, _, c) in zip(rows, brute(rows)):
        if d == c:
            least[d] = t
    assert got == sorted(least.items())


def test_equal_hashes_need_equal_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", None, {"k": 1}), (1, "a b c d", None, "x", {"k": 1})], "doc_id long, text string, p string, q string, m map<string,int>")
    assert len({tuple(r) for r in df.select(*S._row_digest(df)).collect()}) == 2
    assert S.keep_one(df).count() == 1


def test_empty_table(frame):
    assert S.near_duplicates(frame([])).collect() == []
    assert S.keep_one(frame([])).collect() == []


def near_prints(rng, n):
    base = rng.integers(0, 2**64 - 1, 30, dtype=np.uint64)
    out = set(map(int, rng.integers(0, 2**64 - 1, n, dtype=np.uint64))) | {0, 1, 7, 2**64 - 1, 2**63}
    for b in base.tolist():
        for _ in range(40):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_tries_lose_no_link_and_add_none():
    rng = np.random.default_rng(3)
    fps = near_prints(rng, 700)
    place = {int(x): i for i, x in enumerate(fps)}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]
    edges = []
    for order in (0, 1):
        turned = np.sort(S._turn(fps, order))
        half = len(turned) // 3
        for left, right in ((turned[:half], None), (turned[half:], None), (turned[:half], turned[half:])):
            u, v = S.join_tries(left, right, 3, chunk=37)
            pairs = [(place[int(a)], place[int(b)]) for a, b in zip(S._turn(u, order), S._turn(v, order))]
            assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in pairs)
            edges += pairs
    assert components(len(fps), edges) == components(len(fps), near)
    assert len(edges) < 6 * len(fps)  # a forest for each group, not all pairs


def test_cut_and_leaf_pairs_cover_all_links(spark):
    rng = np.random.default_rng(4)
    fps = near_prints(rng, 500)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for order in (0, 1):
        cut = sorted(S.cut_trie(df, order, 20), key=lambda x: x[0] << (64 - x[1]))
        turned = S._turn(fps, order)
        start = np.array([p << (64 - d) for p, d in cut], np.uint64)
        leaf = np.searchsorted(start, turned, side="right") - 1
        assert all(int(f) >> (64 - cut[k][1]) == cut[k][0] for f, k in zip(turned, leaf))
        assert np.bincount(leaf).max() <= 20
        pairs = set(S.leaf_pairs(cut, 3))
        for i in range(len(fps)):
            for j in np.flatnonzero(~S._over(turned[i] ^ turned[:i], 3)):
                assert (min(leaf[i], leaf[j]), max(leaf[i], leaf[j])) in pairs


def test_very_long_text_fold():
    h = np.random.default_rng(1).integers(0, 2**64 - 1, 200_001, dtype=np.uint64)
    got = S.fold(np.concatenate([h[:3], h]), np.array([0, 3, 3, len(h) + 3]))
    want = [sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > len(x)) for x in (h[:3], h)]
    assert got.tolist() == [want[0], 0, want[1]]
