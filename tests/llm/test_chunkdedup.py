"""Chunks against a byte-by-byte gear hash; removal against plain Python; planted passages."""

import numpy as np

from tillpoint.llm import chunkdedup as C


def slow_cuts(data, bits=C.MASK_BITS, least=C.LEAST, most=C.MOST):
    out, at, h, p = [], 0, 0, 0
    n = len(data)
    inside = [b & 0xC0 == 0x80 for b in data] + [False]
    hashes = []
    for b in data:
        h = ((h << 1) + int(C._GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    for p in range(1, n + 1):
        if hashes[p - 1] >> (32 - bits) and p < n:
            continue
        while p - at > most:
            at += most
            while inside[at]:
                at += 1
            out.append(at)
        if p - at >= least:
            while inside[p]:
                p += 1
            at = p
            out.append(at)
    if n and (not out or out[-1] < n):
        out.append(n)
    return out


def test_cuts_equal_the_rolling_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 400, 5000):
        for data in (rng.integers(0, 128, n).astype(np.uint8), np.frombuffer(("é☃" * n)[:n].encode(), np.uint8), np.zeros(n, np.uint8)):
            assert C.cuts(data) == slow_cuts(data.tolist())
            assert all(bytes(data[a:b]).decode() is not None for a, b in zip([0, *C.cuts(data)], C.cuts(data)))


def test_insertions_shift_only_what_they_touch():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    other = np.concatenate([data[:7000], np.frombuffer(b"inserted", np.uint8), data[7000:]])
    chunks = lambda d: {bytes(d[a:b]) for a, b in zip([0, *C.cuts(d)], C.cuts(d))}
    a, b = chunks(data), chunks(other)
    assert len(a - b) <= 4 and len(b - a) <= 4


def brute(rows, min_run=C.MIN_RUN):
    """rows: (row, doc_id, text) in the order of row."""
    seen, parts = {}, {}
    for row, _, t in rows:
        raw = (t or "").encode()
        cut = C.cuts(np.frombuffer(raw, np.uint8))
        parts[row] = [raw[a:b] for a, b in zip([0, *cut], cut)]
        for x, c in enumerate(parts[row]):
            seen.setdefault(c, []).append((row, x))
    out = {}
    for row, doc, t in rows:
        at, spans = 0, []
        for c in parts[row]:
            spans.append((at, at + len(c.decode())))
            at = spans[-1][1]
        run, gone, n_shared = [], [], 0
        for x in range(len(spans) + 1):
            if x < len(spans) and len(seen[parts[row][x]]) > 1:
                run.append(x)
                continue
            if run and spans[run[-1]][1] - spans[run[0]][0] >= min_run:
                n_shared += len(run)
                gone += [y for y in run if seen[parts[row][y]][0] != (row, y)]
            run = []
        merged = []
        for y in gone:
            if merged and merged[-1][1] == spans[y][0]:
                merged[-1][1] = spans[y][1]
            else:
                merged.append(list(spans[y]))
        out[row] = (doc, at, len(spans), n_shared, len(gone), sum(b - a for a, b in merged), n_shared > 0,
                    ",".join(f"{a}:{b}" for a, b in merged))
    return out


def result(df):
    return {r.row: tuple(r)[:8] for r in C.dedup(df).collect()}


def numbered(df):
    from pyspark.sql import functions as F
    return sorted((r.row, r.doc_id, r.text) for r in df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").collect())


def test_documents_equal_brute_force(documents):
    assert result(documents) == brute(numbered(documents))


def test_odd_rows(odd, frame):
    odd = odd.cache()
    assert result(odd) == brute(numbered(odd))
    assert result(frame([])) == {}


def test_planted_passages_are_found_and_clean_texts_left_alone(frame):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(55) for _ in range(30)]
    rows, planted = [], set()
    for i in range(120):
        t = text(200)
        if i % 2:
            t += " " + passages[i % 30] + " " + text(60)
            planted.add(i)
        rows.append((i, t))
    df = frame(rows).cache()
    got = C.dedup(df).collect()
    assert {r.doc_id for r in got if r.has_repeats} == planted
    texts = {r.doc_id: r.text for r in C.remove_spans(df, C.dedup(df)).collect()}
    whole = dict(rows)
    assert all(texts[i] == whole[i] for i in range(0, 120, 2))
    assert sum(texts[i] != whole[i] for i in planted) == len(planted) - 15


def test_short_copies_go_whole_and_stock_phrases_stay(frame):
    stock = "All rights reserved by the owner."
    rng = np.random.default_rng(5)
    long = lambda: "".join(rng.choice(list("abcdefghij "), 400))
    two = "first chunk of a short text, and then some more of it"  # several chunks, fewer than 100 characters
    rows = [(1, "hi"), (2, "hi"), (3, "hi"), (4, two), (5, two), (6, "another one that is alone"), (7, None), (8, ""), (9, ""), (10, "only once"),
            (11, long() + stock + long()), (12, long() + stock + long())]
    df = frame(rows).coalesce(1).cache()
    got = C.dedup(df, whole_texts=True).collect()
    texts = dict(rows)
    for same in ({1, 2, 3}, {4, 5}):
        of = sorted((r for r in got if r.doc_id in same), key=lambda r: r.row)
        assert all(r.has_repeats and r.n_shared_chunks == r.n_chunks for r in of)
        assert [r.removed_spans for r in of] == [""] + [f"0:{len(texts[r.doc_id])}" for r in of[1:]]
    assert not any(r.has_repeats or r.removed_spans for r in got if r.doc_id >= 6)
    assert not any(r.has_repeats for r in C.dedup(df).collect())
    kept = {r.doc_id: r.text for r in C.remove_spans(df, C.dedup(df, whole_texts=True)).collect()}
    assert sorted(kept[i] for i in (1, 2, 3)) == ["", "", "hi"] and sorted(kept[i] for i in (4, 5)) == ["", two]
    assert all(kept[i] == texts[i] for i in range(6, 13))


def test_the_query_finds_all_exact_copies(spark):
    from pyspark.sql import functions as F
    from conftest import SMALL
    from tillpoint.llm.queries import op3
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.where("text != ''").groupBy("text").count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert op3(spark, SMALL).where("n_chars > 0 and removed_chars = n_chars").count() >= n
