"""Pieces against the tokenizer itself; sequences against their definition."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tillpoint.llm import packing as K

HARD = ["", " ", "\n", "  a  b ", "x  y\n\n z  ", "foo <|endoftext|> bar<|endoftext|>  ", " it's we'll 'tis \"x\" “y”. a1b2,c… ''s",
        "日本語 テスト。　 x", "a\r\n\r\n b\t\tc  \n", " \n ", "x\xa0 y \x85z £5 ½x", " a   b\n c", "a\nb\n\nc\n \nd .\ne",
        "A.B,c's 12,3 %%% !\"#", "é, è. à\nÉ", "\x1c a \x1d\n", "ſß ǅ x"]


def ids(texts):
    t = Tokenizer.from_file(K.tokenizer_path(K.VOCABULARY))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoder():
    return K.Encoder(K.tokenizer_path(K.VOCABULARY), K.tokenizer_path(K.RANKS))


def test_ids_equal_the_tokenizer(documents):
    texts = HARD + [r.text or "" for r in documents.collect()]
    got = [x.tolist() for x in encoder().batch(pa.array(texts))]
    assert got == ids(texts)


def test_ids_of_random_characters():
    rng = np.random.default_rng(2)
    alphabet = list("ab Z.,'\n\n  \t!0é\xa0 ñ—%") + ["<|endoftext|>", "'s", "  "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)]
    assert [x.tolist() for x in encoder().batch(pa.array(texts))] == ids(texts)


def check(rows, texts, capacity=K.CAPACITY):
    """All documents are there in pieces that tile their ids; sequences are gapless and within the capacity."""
    left = sorted(map(tuple, ((d, tuple([*x, 2])) for d, x in zip(texts, ids([t or "" for t in texts.values()])))))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, want in left:
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == np.concatenate([[0], np.cumsum([p.length for p in pieces])[:-1]]).tolist()
        assert sum(p.length for p in pieces) == len(want)
        assert len(pieces) == -(-len(want) // capacity)
        for p in pieces:
            part = np.array(want[p.start:p.start + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
    gapless(rows, capacity)


def gapless(rows, capacity=K.CAPACITY):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_documents_are_packed_whole(documents):
    rows = K.pack(documents).collect()
    check(rows, {r.doc_id: r.text for r in documents.collect()})
    assert gapless(rows) <= 1.02 * sum(r.length for r in rows) / K.CAPACITY + 2


def test_rounds_of_many_tasks(documents):
    rows = K.pack(documents.repartition(7), share=20, fan_in=2).collect()
    check(rows, {r.doc_id: r.text for r in documents.collect()})


def test_odd_rows(odd):
    rows = K.pack(odd, capacity=64).collect()
    gapless(rows, 64)
    n = {}
    for r in rows:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = {}
    for (d, _), x in zip(texts, ids([t for _, t in texts])):
        want[d] = want.get(d, 0) + len(x) + 1
    assert n == want
    assert sum(r.piece == 0 for r in rows) == odd.count()


def test_empty_table(frame):
    assert K.pack(frame([])).collect() == []


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fill = K.best_fit(np.array([6, 5, 4, 3, 5]), 10)
    assert bins.tolist() == [0, 1, 0, 2, 1] and offsets.tolist() == [0, 0, 6, 0, 5] and fill.tolist() == [10, 10, 3]


def test_cut_keeps_the_short_piece_first():
    assert K.cut(1, 4) == [(0, 1)] and K.cut(4, 4) == [(0, 4)] and K.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
