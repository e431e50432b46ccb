"""Language identification: a byte convolutional network written in numpy.

Bytes are embedded, filters of several widths slide over fixed windows of
``WINDOW`` bytes, each filter keeps its maximum over the window, and a softmax
layer gives the window's language. The network is trained on the driver on a
bounded sample (``per_language`` documents of each language in expectation,
``windows_each`` windows of each, twice that in total at most).

Every window of every text is scored. Since the input is bytes, a filter's
response is a sum of table lookups (pairs of bytes have one table each), so
applying the network needs no matrix products until after the pooling.

Null texts and texts without a letter are ``und`` with score 0, and so is
everything when no labelled text exists. Ties go to the first language in
sorted order. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.text import ranges, slices, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
PER_LANGUAGE = 300
WINDOWS_EACH = 3
EPOCHS = 12
BATCH = 64
RATE = 0.01
UNDECIDED = "und"
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numerals like ² that are none


@dataclass
class ByteNet:
    """Weights: embedding (256, e), a filter bank (width, e, f) with bias (f) for each width, output (3f, c), (c)."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zero bytes, their document, their number of real bytes)."""
    length = np.diff(offsets)
    count = -(-length // window)
    doc = np.repeat(np.arange(len(length)), count)
    start = ranges(np.zeros(len(length), np.int64), count) * window
    real = np.minimum(window, length[doc] - start)
    out = np.zeros((len(doc), window), np.uint8)
    filled = np.arange(window) < real[:, None]
    out[filled] = data[ranges(offsets[:-1][doc] + start, real)]
    return out, doc, real


def _columns(x: np.ndarray, width: int) -> np.ndarray:
    n, t, e = x.shape
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, t - width + 1, width, e), (s[0], s[1], s[1], s[2])) \
        .reshape(n, t - width + 1, width * e)


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Fit the network by Adam on (language, window) samples; classes weigh alike."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    c, f = len(languages), FILTERS
    y = np.array([languages.index(lang) for lang, _ in samples])
    x = np.zeros((len(samples), WINDOW), np.uint8)
    for i, (_, w) in enumerate(samples):
        x[i, :min(WINDOW, len(w))] = np.frombuffer(w[:WINDOW], np.uint8)
    weight = (len(y) / (c * np.bincount(y, minlength=c)))[y].astype(np.float32)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = [normal(256, EMBEDDING, scale=0.5)]
    for w in WIDTHS:
        p += [normal(w * EMBEDDING, f, scale=(2 / (w * EMBEDDING)) ** 0.5), np.zeros(f, np.float32)]
    p += [normal(f * len(WIDTHS), c, scale=(1 / (f * len(WIDTHS))) ** 0.5), np.zeros(c, np.float32)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at:at + BATCH]
            xb, yb, wb = x[rows].astype(np.int64), y[rows], weight[rows]
            e = p[0][xb]
            cols, where, pooled = [], [], []
            for k, w in enumerate(WIDTHS):
                col = _columns(e, w)
                z = col @ p[1 + 2 * k] + p[2 + 2 * k]
                top = z.argmax(axis=1)
                cols.append(col)
                where.append(top)
                pooled.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            a = np.maximum(h, 0)
            logits = a @ p[-2] + p[-1]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob
            d[np.arange(len(rows)), yb] -= 1
            d *= (wb / len(rows))[:, None]
            grad = [np.zeros_like(q) for q in p]
            grad[-2], grad[-1] = a.T @ d, d.sum(axis=0)
            dh = (d @ p[-2].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                part = dh[:, k * f:(k + 1) * f]
                best = np.take_along_axis(cols[k], where[k][:, :, None], 1)  # (rows, f, w*e): each filter's best place
                grad[1 + 2 * k] = np.einsum("nfe,nf->ef", best, part)
                grad[2 + 2 * k] = part.sum(axis=0)
                back = (part[:, :, None] * p[1 + 2 * k].T[None]).reshape(len(rows), f, w, EMBEDDING)
                for j in range(w):
                    byte = np.take_along_axis(xb, where[k] + j, 1)
                    np.add.at(grad[0], byte.ravel(), back[:, :, j].reshape(-1, EMBEDDING))
            step += 1
            for q, g, m, v in zip(p, grad, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return ByteNet(languages, p[0], [q.reshape(w, EMBEDDING, f) for w, q in zip(WIDTHS, p[1:-2:2])],
                   list(p[2:-2:2]), p[-2], p[-1])


class Scorer:
    """The network as lookup tables: one for each filter and each pair of bytes it spans (or single last byte)."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.tables: list[list[tuple[int, bool, np.ndarray]]] = []  # per filter: (offset, is a pair, table)
        for bank, bias in zip(net.filters, net.biases):
            width = len(bank)
            single = [np.ascontiguousarray((net.embedding @ bank[j]).T) for j in range(width)]  # (f, 256)
            for k in range(bank.shape[2]):
                parts = []
                for j in range(0, width - 1, 2):
                    pair = single[j][k][:, None] + single[j + 1][k][None, :]
                    parts.append((j, True, (pair + (bias[k] if j == 0 else 0)).ravel().astype(np.float32)))
                if width % 2:
                    parts.append((width - 1, False, single[width - 1][k].astype(np.float32)))
                self.tables.append(parts)
        self.widths = [len(b) for b in net.filters for _ in range(b.shape[2])]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each document's windows, weighed by their bytes."""
        n, c = len(offsets) - 1, len(self.net.languages)
        x, doc, real = windows(data, offsets)
        if not len(x):
            return np.zeros((n, c))
        byte = x.astype(np.intp)
        pair = (byte[:, :-1] << 8) | byte[:, 1:]
        pooled = np.empty((len(x), len(self.tables)), np.float32)
        for k, (parts, width) in enumerate(zip(self.tables, self.widths)):
            span = WINDOW - width + 1
            total = None
            for at, is_pair, table in parts:
                got = table.take(pair[:, at:at + span] if is_pair else byte[:, at:at + span])
                total = got if total is None else np.add(total, got, out=total)
            pooled[:, k] = total.max(axis=1)
        logits = np.maximum(pooled, 0) @ self.net.out + self.net.out_bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        first = np.searchsorted(doc, np.arange(n))
        total = np.zeros((n, c))
        some = np.diff(np.append(first, len(doc))) > 0
        weighed = prob * real[:, None]
        total[some] = np.add.reduceat(weighed, first[some], axis=0)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE,
           windows_each: int = WINDOWS_EACH) -> list[tuple[str, bytes]]:
    """Bounded labelled windows: documents by hash, at places by hash."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"),
                       F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null and t != ''")
    counts = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return []
    scale = 1 << 20
    rate = F.lit(0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col("l") == lang, F.lit(min(scale, -(-per_language * scale // n)))).otherwise(rate)
    picked = rows.where(F.pmod(F.xxhash64("i", F.lit(1)), F.lit(scale)) < rate)
    place = F.pmod(F.xxhash64("i", "k"), F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1).cast("int")
    got = (picked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(windows_each))))
                 .select("l", "i", "k", F.substring("t", place + 1, F.lit(WINDOW)).alias("w"))
                 .limit(2 * per_language * windows_each * len(counts)).collect())
    return sorted((r.l, r.w.encode()[:WINDOW]) for r in got)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH) -> ByteNet | None:
    """A network trained on ``docs`` (null when there is no labelled text)."""
    samples = sample(docs, id_col, text_col, lang_col, per_language, windows_each)
    return train(samples) if samples else None


def _has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def _predict(column: pa.Array, scorer: Scorer | None) -> tuple[list[str], list[float]]:
    if scorer is None:
        return [UNDECIDED] * len(column), [0.0] * len(column)
    data, offsets = texts(column)
    langs, scores = [], []
    for i, j in slices(offsets, 1 << 20):
        prob = scorer.probabilities(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        best = prob.argmax(axis=1)
        langs += [scorer.net.languages[k] for k in best.tolist()]
        scores += prob[np.arange(len(best)), best].tolist()
    for i, t in enumerate(column):
        if not _has_letter(t.as_py()):
            langs[i], scores[i] = UNDECIDED, 0.0
    return langs, [min(1.0, max(0.0, s)) for s in scores]


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; a map-only pass."""

    def run(batches):
        scorer = Scorer(net) if net else None
        for batch in batches:
            langs, scores = _predict(batch.column(1), scorer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
               .mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteNet | None, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """``docs`` without rows whose language is undecided or scores below ``min_score``; without a network all
    rows with a letter stay."""
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(net) if net else None
        for batch in batches:
            column = batch.column(place)
            if scorer is None:
                keep = [_has_letter(t.as_py()) for t in column]
            else:
                langs, scores = _predict(column, scorer)
                keep = [lang != UNDECIDED and s >= min_score for lang, s in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
