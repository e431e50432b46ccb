"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over whole texts.

Fit, on a bounded sample (``per_class`` labelled documents of each class, by
hash of their id): every word of the examples is indexed. A word weighs
(1 + ln tf) * idf, idf from the document frequencies in all documents (one Spark
aggregation); texts are unit vectors. Examples are ordered by repeated halving,
each time by two means of cosine, and cut into blocks of ``BLOCK`` alike ones; the
inverted index holds the largest weight of each word in each block where it occurs. The few
words that are in most blocks have their postings as whole rows.

Score: the whole rows are multiplied out, and a block's bound is its largest sum of them plus
the largest weights of the text's other words.
The ``FIRST`` blocks of highest bound are opened, then every block whose bound
reaches the k-th similarity, so the k nearest by cosine are exact. A neighbour votes by
how near it is in the words that tell the classes apart: its similarity with each word's
share multiplied by the chi-square of the word and the label in the sample (1 for all
words where there is one class), and by the class's share in the labels over its share
in the sample. The label plays no part in the search. Raw votes are calibrated by isotonic
regression on the sample, each example scored without itself. Ties go to the smaller doc_id.

Texts without a word of any example (null and empty ones too) have no neighbours
and score the share of toxic documents among such examples. Where an id has
several labels the largest counts; where it has several texts the smallest.
Without labels every score is 0, with one class it is that class's. Words are
known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored
from tillpoint.llm.text import ALNUM, LOWER, SpanHasher, ranges, slices, spans, texts

PER_CLASS = 2000
BLOCK = 32
FIRST = 8
DENSE = 512  # words of at least 1/16 of the examples, at most so many
ROUNDS = 6  # of two means at each halving
CHUNK = 256  # queries searched at a time, fewer
AT_ONCE = 1 << 19  # where they meet more runs than so many
NEIGHBOURS = 15
PREDICT_FROM = 0.3


@dataclass
class Terms:
    """Sparse rows: ``n`` texts, and for each word of each text its row, its place in the vocabulary and its value."""

    n: int
    doc: np.ndarray  # ascending
    term: np.ndarray
    value: np.ndarray


@dataclass
class Index:
    """Block-max inverted index of the examples."""

    terms: list[bytes]
    keys: np.ndarray  # hash of each word; empty where ``terms`` has the words
    term_weight: np.ndarray
    ids: np.ndarray  # doc_id of each example, ascending
    toxic: np.ndarray
    weight: np.ndarray  # of each example's vote
    label_weight: np.ndarray  # of each word
    order: np.ndarray  # example at each place of the blocks
    dense_place: np.ndarray  # of each word, -1 where it has runs
    dense: np.ndarray  # (words with whole rows, places)
    own: np.ndarray  # [example]: its first word below
    own_term: np.ndarray
    own_value: np.ndarray
    runs: np.ndarray  # [word]: its first run; a run is one word's postings in one block
    run_block: np.ndarray
    run_max: np.ndarray
    run_start: np.ndarray  # [run]: its first posting
    place: np.ndarray  # [posting]: its example's
    value: np.ndarray
    prior: float = 0.0
    empty_score: float = 0.0
    raw_steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step_scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    opened: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))  # blocks opened so far, and of how many

    def nearest(self, q: np.ndarray | Terms, k: int = NEIGHBOURS,
                without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k nearest of each row of unit queries; -1 and 0 where there are fewer.

        ``without`` names for each query one example to leave out.
        """
        if not isinstance(q, Terms):
            doc, term = np.nonzero(q)
            q = Terms(len(q), doc, term, q[doc, term])
        best, sims = np.full((q.n, k), -1, np.int64), np.zeros((q.n, k))
        if not len(self.ids):
            return best, sims
        for a, b in _chunks(np.bincount(q.doc, self.runs[q.term + 1] - self.runs[q.term], q.n), CHUNK):
            i, j = np.searchsorted(q.doc, (a, b))
            best[a:b], sims[a:b] = self._search(Terms(b - a, q.doc[i:j] - a, q.term[i:j], q.value[i:j]), k,
                                                None if without is None else without[a:b])
        return best, sims

    def _search(self, q: Terms, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        blocks = -(-len(self.ids) // BLOCK)
        width = blocks * BLOCK
        at = self.dense_place[q.term]
        on = at >= 0
        some = np.zeros((q.n, len(self.dense)))
        some[q.doc[on], at[on]] = q.value[on]
        score = some @ self.dense
        if without is not None:
            score[np.arange(q.n), np.argsort(self.order)[without]] = -np.inf
        count = self.runs[q.term + 1] - self.runs[q.term]
        run, doc, value = ranges(self.runs[q.term], count), np.repeat(q.doc, count), np.repeat(q.value, count)
        block = self.run_block[run]
        bound = np.maximum(score.reshape(q.n, blocks, BLOCK).max(axis=2), 0)
        bound += np.bincount(doc * blocks + block, value * self.run_max[run], q.n * blocks).reshape(q.n, blocks)

        def open_blocks(wanted: np.ndarray) -> None:
            at = np.flatnonzero(wanted[doc, block])
            size = self.run_start[run[at] + 1] - self.run_start[run[at]]
            post = ranges(self.run_start[run[at]], size)
            score.reshape(-1)[:] += np.bincount(np.repeat(doc[at] * width, size) + self.place[post],
                                                np.repeat(value[at], size) * self.value[post], q.n * width)

        opened = np.zeros((q.n, blocks), bool)
        np.put_along_axis(opened, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        open_blocks(opened)
        most = min(k, width)
        # weights are not negative: sums so far are lower bounds
        least = np.partition(score, width - most, axis=1)[:, [width - most]]
        more = ~opened & (bound > 0) & (bound * (1 + 1e-9) + 1e-11 >= least)
        open_blocks(more)
        self.opened += (opened.sum() + more.sum(), opened.size)
        score = np.round(score, 12)
        least = np.partition(score, width - most, axis=1)[:, [width - most]]
        row, place = np.nonzero((score > 0) & (score >= least))
        got, example = score[row, place], self.order[place]
        order = np.lexsort((example, -got, row))
        row, example, got = row[order], example[order], got[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best, sims, top = np.full((q.n, k), -1, np.int64), np.zeros((q.n, k)), rank < k
        best[row[top], rank[top]], sims[row[top], rank[top]] = example[top], got[top]
        return best, sims

    def votes(self, q: Terms, best: np.ndarray) -> np.ndarray:
        """Similarity of each neighbour with its words weighed by how they tell the classes apart."""
        out, mine = np.zeros(best.shape), np.zeros(len(self.label_weight))
        edge = np.searchsorted(q.doc, np.arange(q.n + 1))
        for d in np.flatnonzero(best[:, 0] >= 0).tolist():
            near = best[d][best[d] >= 0]
            term = q.term[edge[d]:edge[d + 1]]
            mine[term] = q.value[edge[d]:edge[d + 1]] * self.label_weight[term]
            size = self.own[near + 1] - self.own[near]
            at = ranges(self.own[near], size)
            out[d, :len(near)] = np.bincount(np.repeat(np.arange(len(near)), size), mine[self.own_term[at]] * self.own_value[at],
                                             len(near))
            mine[term] = 0
        return out

    def raw(self, best: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """Share of toxic votes, with one vote of the prior."""
        w = np.where(best >= 0, votes * self.weight[best], 0)
        return ((w * self.toxic[best]).sum(axis=1) + self.prior) / (w.sum(axis=1) + 1)

    def calibrated(self, raw: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if not len(self.raw_steps):
            return np.full(len(raw), self.empty_score)
        return np.where(empty, self.empty_score, np.interp(raw, self.raw_steps, self.step_scores))

    def unit(self, tf: np.ndarray) -> np.ndarray:
        v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * self.term_weight
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def unit_terms(self, tf: Terms) -> Terms:
        return Terms(tf.n, tf.doc, tf.term, _units(tf, self.term_weight))


def _chunks(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``most`` items that cost ``AT_ONCE`` together, or of one item."""
    total, a = np.cumsum(cost), 0
    while a < len(cost):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, side="right"))
        b = min(max(b, a + 1), a + most)
        yield a, min(b, len(cost))
        a = b


def _units(tf: Terms, term_weight: np.ndarray) -> np.ndarray:
    v = (1 + np.log(tf.value)) * term_weight[tf.term]
    return v / np.maximum(np.sqrt(np.bincount(tf.doc, v * v, tf.n)), 1e-12)[tf.doc]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (x at the middle of each pool, its mean), rising."""
    pools: list[list[float]] = []  # weight, weight * y, weight * x
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]
                                  or pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def build(rows: list[tuple[int, int, dict[bytes, int]]], terms: list[bytes], prior: float) -> Index:
    """Index of (doc_id, toxic, term counts) examples over a vocabulary; ``prior``: share of toxic labels."""
    rows = sorted(rows, key=lambda r: r[0])
    place = {t: i for i, t in enumerate(terms)}
    at = sorted((i, place[t], n) for i, (_, _, counts) in enumerate(rows) for t, n in counts.items() if t in place)
    doc, term, n = np.array(at, np.int64).reshape(-1, 3).T
    return _index(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float),
                  Terms(len(rows), doc, term, n.astype(float)), np.bincount(term, minlength=len(terms)), len(rows), prior, terms=terms)


def label_weight(toxic: np.ndarray, tf: Terms, n_terms: int) -> np.ndarray:
    """Chi-square of each word and the label: the square of the z of its shares in both classes."""
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    if not n1 or not n0:
        return np.ones(n_terms)
    d1 = np.bincount(tf.term, toxic[tf.doc], n_terms)
    d0 = np.bincount(tf.term, 1 - toxic[tf.doc], n_terms)
    p = (d1 + d0) / (n1 + n0)
    return (d1 / n1 - d0 / n0) ** 2 / (np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))


def halved(tf: Terms, v: np.ndarray, n_terms: int) -> np.ndarray:
    """Rows of unit vectors in an order that puts alike ones into the same block: halves by two means, and so on."""
    out, work = [], [(np.arange(tf.n), tf.doc, tf.term, v)]
    while work:
        rows, doc, term, value = work.pop()
        n = len(rows)
        if n <= BLOCK:
            out.append(rows)
            continue
        # from the first row and the one least like it
        like = np.bincount(doc, value * np.bincount(term[doc == 0], value[doc == 0], n_terms)[term], n)
        side = np.zeros(n)
        side[0], side[1 + np.argmin(like[1:])] = 1, -1
        half = -(-(n // 2) // BLOCK) * BLOCK
        for _ in range(ROUNDS):
            lean = np.bincount(doc, value * np.bincount(term, value * side[doc], n_terms)[term], n)
            order = np.argsort(-lean, kind="stable")
            side = np.full(n, -1 / max(n - half, 1))
            side[order[:half]] = 1 / half
        for mine in (side < 0, side > 0):
            on, at = mine[doc], np.cumsum(mine) - 1
            work.append((rows[mine], at[doc[on]], term[on], value[on]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _index(ids: np.ndarray, toxic: np.ndarray, tf: Terms, df: np.ndarray, n_docs: int, prior: float,
           keys: np.ndarray | None = None, terms: list[bytes] | None = None) -> Index:
    """Index of examples in the order of their ids; ``df``: of each word, in ``n_docs`` documents."""
    share = toxic.mean() if len(ids) else 0.0
    weight = np.where(toxic == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    v = _units(tf, idf)
    order = halved(tf, v, len(df))
    at = np.argsort(order)[tf.doc] if len(tf.doc) else tf.doc
    here = np.bincount(tf.term, minlength=len(df))
    rows = np.argsort(-here, kind="stable")[:DENSE]
    rows = rows[here[rows] * 16 >= max(len(ids), 1)]
    dense_place = np.full(len(df), -1)
    dense_place[rows] = np.arange(len(rows))
    dense = np.zeros((len(rows), -(-len(ids) // BLOCK) * BLOCK))
    on = dense_place[tf.term] >= 0
    dense[dense_place[tf.term[on]], at[on]] = v[on]
    sort = np.flatnonzero(~on)[np.lexsort((at[~on], tf.term[~on]))]
    term, place, value = tf.term[sort], at[sort], v[sort]
    first = np.ones(len(sort), bool)
    first[1:] = (term[1:] != term[:-1]) | (place[1:] // BLOCK != place[:-1] // BLOCK)
    start = np.flatnonzero(first)
    index = Index(terms or [], np.zeros(0, np.uint64) if keys is None else keys, idf, ids, toxic, weight,
                  label_weight(toxic, tf, len(df)), order, dense_place, dense, np.searchsorted(tf.doc, np.arange(len(ids) + 1)), tf.term, v,
                  np.searchsorted(term[start], np.arange(len(df) + 1)), place[start] // BLOCK,
                  np.maximum.reduceat(value, start) if len(start) else value, np.append(start, len(sort)), place, value, prior)
    empty = np.bincount(tf.doc, minlength=len(ids)) == 0
    w = weight + 1e-12
    index.empty_score = float((w * toxic)[empty].sum() / w[empty].sum()) if empty.any() else prior
    if len(ids) and not empty.all():
        units = Terms(len(ids), tf.doc, tf.term, v)
        best, _ = index.nearest(units, without=np.arange(len(ids)))
        raw = index.raw(best, index.votes(units, best))[~empty]
        index.raw_steps, index.step_scores = isotonic(raw, toxic[~empty], w[~empty])
    return index


def word_hashes(column: pa.Array, hasher: SpanHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, text of each word, hash of each word), in slices."""
    data, offsets = texts(column)
    for i, j in slices(offsets):
        sp = spans(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], ALNUM, hasher)
        yield i, j - i, np.searchsorted(sp.doc, np.arange(len(sp.hash)), side="right") - 1, sp.hash


def known_terms(column: pa.Array, hasher: SpanHasher, keys: np.ndarray) -> Iterator[Terms]:
    """Counts of the vocabulary's words (sorted hashes) in each text, in slices."""
    for _, n, doc, hashes in word_hashes(column, hasher):
        if not len(keys):
            yield Terms(n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            continue
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == hashes)
        pair, count = np.unique(doc[hit] * len(keys) + at[hit], return_counts=True)
        yield Terms(n, pair // len(keys), pair % len(keys), count.astype(float))


def document_frequencies(docs: DataFrame, keys: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents with each of the words, documents) over all of ``docs``: one row a word and task, summed by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)  # bounded by the sample

    def counted(batches):
        keys, hasher = shared.value, SpanHasher(lower=True)
        n, df = 0, np.zeros(len(keys), np.int64)
        for batch in batches:
            n += batch.num_rows
            for tf in known_terms(batch.column(0), hasher, keys):
                df += np.bincount(tf.term, minlength=len(keys))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])

    got = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "term long, n long")
               .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    term, n = (got.column(i).to_numpy() for i in range(2))
    df = np.zeros(len(keys), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = PER_CLASS) -> Index:
    """Index of a bounded sample of the labelled documents; document frequencies of all of ``docs``."""
    labelled = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
                      .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
                      .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    total = sum(count.values())
    picked = [labelled.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in count]
    if not total:
        return build([], [], 0.0)
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    chosen = stored(chosen, "toxicity-sample")  # at most 2 * per_class ids
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    def counted(batches):
        # the words of each example, led by a head of count 0
        hasher = SpanHasher(lower=True)
        for batch in batches:
            ids, toxic = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(2))
            for i, n, doc, hashes in word_hashes(batch.column(2), hasher):
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                first = np.ones(len(doc), bool)
                first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                start = np.flatnonzero(first)
                at = np.concatenate([np.arange(n), doc[start]]) + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(toxic[at].astype(np.int32)),
                     pa.array(np.concatenate([np.zeros(n, np.int64), hashes[start].view(np.int64)])),
                     pa.array(np.concatenate([np.zeros(n, np.int64), np.diff(np.append(start, len(doc)))]))],
                    names=["doc_id", "toxic", "term", "n"])

    got = rows.mapInArrow(counted, "doc_id long, toxic int, term long, n long").toArrow()
    doc_id, toxic, term, n = (got.column(i).to_numpy() for i in range(4))
    ids, at = np.unique(doc_id[n == 0], return_index=True)
    toxic, word = toxic[n == 0][at].astype(float), n > 0
    keys, place = np.unique(term[word].view(np.uint64), return_inverse=True)
    doc = np.searchsorted(ids, doc_id[word])
    order = np.lexsort((place, doc))
    df, n_docs = document_frequencies(docs, keys, text_col)
    return _index(ids, toxic, Terms(len(ids), doc[order], place[order], n[word][order].astype(float)), df, n_docs,
                  count.get(1, 0) / total, keys=keys)


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text",
          predict_from: float = PREDICT_FROM) -> DataFrame:
    """``doc_id, score, predicted`` and the evidence: the nearest examples, their similarities and labels. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample
    names = ["doc_id", "score", "predicted", "evidence_ids", "evidence_sims", "evidence_toxic"]

    def run(batches):
        index, hasher = shared.value, SpanHasher(lower=True)
        for batch in batches:
            out = [[] for _ in names[1:]]
            for tf in known_terms(batch.column(1), hasher, index.keys):
                units = index.unit_terms(tf)
                best, sims = index.nearest(units)
                empty = np.bincount(tf.doc, minlength=tf.n) == 0
                raw = index.raw(best, index.votes(units, best)) if len(index.ids) else np.zeros(tf.n)
                got = np.clip(index.calibrated(raw, empty), 0, 1)
                for d, s in enumerate(got.tolist()):
                    ok = best[d] >= 0
                    out[0].append(s)
                    out[1].append(int(s >= predict_from))
                    out[2].append(index.ids[best[d][ok]].tolist())
                    out[3].append(sims[d][ok].tolist())
                    out[4].append(index.toxic[best[d][ok]].astype(int).tolist())
            types = [pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, evidence_ids array<long>, evidence_sims array<double>, "
             "evidence_toxic array<int>")
