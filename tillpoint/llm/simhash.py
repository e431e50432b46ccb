"""SimHash near-duplicates: a self-join of a binary trie over the fingerprints.

Fingerprint: bit i is 1 if it is set in more than half of the XXH64 hashes of
the text's word shingles. Documents whose fingerprints differ in at most
``max_bits`` bits are linked; the component's smallest doc_id names it.

The distinct fingerprints form a binary trie. Node pairs are traversed
together from the top; a pair carries the bits in which its two prefixes
differ and is pruned when they exceed the error budget. Of 3 errors in 64
bits at most 1 falls into one of the halves, so two tries are joined, one for
each order of the halves, with a budget of ``max_bits // 2`` within the first
half and ``max_bits`` overall: no link is lost and the frontier grows with
N log N, not with all 3-error prefixes.

The upper trie is cut into at most about ``leaves`` subtries: histograms of
prefixes, read only below heavy nodes, tell where; the traversal over the cut gives the subtrie pairs that can
still hold a link. Each pair is one group of at most two subtries and
continues the traversal in numpy, depth first in bounded chunks. Groups emit
a spanning forest of what they find, never all pairs: node pairs whose members
are known to be connected already are pruned. Equal fingerprints are collapsed
before everything, so a group of copies is one fingerprint.

Null texts and texts without words have fingerprint zero and are linked like
any other. Repeated rows are one document each in the result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tillpoint.cluster.components import connected_components
from tillpoint.llm.scratch import stored
from tillpoint.llm.text import ranges

SHINGLE = 3
MAX_BITS = 3
SEED = 42
LEAVES = 4096
LEAF_ROWS = 4096
FIRST_LEVELS, NEXT_LEVELS = 12, 6
HOT_SHARE = 1000
CHUNK = 1 << 16
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of the shingles of a text, in order, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def fold(all_hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes; run i is first[i]:first[i+1]."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if not len(all_hashes):
        return out
    some = n > 0
    ones = np.zeros((int(some.sum()), 64), np.int64)
    step, at = 1 << 16, first[:-1][some]
    for a in range(0, len(all_hashes), step):  # 64 bytes a hash, a bounded number at once
        part = all_hashes[a:a + step].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i = max(0, int(np.searchsorted(at, a, side="right")) - 1)
        j = int(np.searchsorted(at, a + len(part), side="left"))
        ones[i:j] += np.add.reduceat(bits, np.maximum(at[i:j] - a, 0), axis=0, dtype=np.int64)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out[some] = ((2 * ones > n[some][:, None]) * bit).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 keep: list[str] | None = None) -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits) and the ``keep`` columns."""
    keep = list(keep or [])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
                      *[F.col(c) for c in keep])

    def run(batches):
        for batch in batches:
            of, count = [], []
            for t in batch.column(1):
                h = hashes(t.as_py(), shingle)
                of.append(np.array(h, np.uint64))
                count.append(len(h))
            fp = fold(np.concatenate(of) if of else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(count)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp.view(np.int64)), *[batch.column(i + 2) for i in range(len(keep))]],
                names=["doc_id", "fp", *keep])

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    return src.mapInArrow(run, "doc_id long, fp long" + extra)


def _popcount(x: np.ndarray) -> np.ndarray:
    return (_POP[x & np.uint64(0xFFFF)] + _POP[(x >> np.uint64(16)) & np.uint64(0xFFFF)]
            + _POP[(x >> np.uint64(32)) & np.uint64(0xFFFF)] + _POP[x >> np.uint64(48)])


def _over(diff: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether differing bits exceed the budget of the first half or of all."""
    return (_popcount(diff >> np.uint64(32)) > max_bits // 2) | (_popcount(diff) > max_bits)


def _turn(fp, order: int):
    """Fingerprints with the half that leads in this order on top."""
    return fp if order == 0 else ((fp << np.uint64(32)) | (fp >> np.uint64(32)))


def cut_trie(distinct: DataFrame, order: int, leaf_rows: int) -> list[tuple[int, int]]:
    """Subtries (prefix, depth) that tile the trie and hold at most ``leaf_rows`` rows each.

    Prefix counts are read a few levels at a time, and only below nodes that
    are still too heavy. There are at most rows / ``leaf_rows`` of those, so
    what reaches the driver is bounded by the number of leaves.
    """
    fp = F.col("fp") if order == 0 else F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)")
    rows = distinct.select(fp.alias("fp"))
    heavy, depth, leaves = {0}, 0, []
    while heavy and depth < 64:
        step = min(FIRST_LEVELS if not depth else NEXT_LEVELS, 64 - depth)
        below = rows
        if depth:
            above = F.shiftrightunsigned("fp", 64 - depth)
            below = rows.where(above.isin([p - (1 << 64) if p >= 1 << 63 else p for p in heavy]))
        depth += step
        counts = {int(r[0]) % (1 << 64): int(r[1]) for r in
                  below.groupBy(F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")).count().collect()}
        level = {p: 0 for p in heavy}
        for d in range(depth - step, depth + 1):
            level = {}
            for p, n in counts.items():
                q = p >> (depth - d)
                level[q] = level.get(q, 0) + n
            level = {p: n for p, n in level.items() if d == depth - step or (p >> 1) in heavy}
            leaves += [(p, d) for p, n in level.items() if n <= leaf_rows or d == 64]
            heavy = {p for p, n in level.items() if n > leaf_rows and d < 64}
    return leaves or [(0, 0)]


def leaf_pairs(leaves: list[tuple[int, int]], max_bits: int) -> list[tuple[int, int]]:
    """Pairs of cut subtries (places in ``leaves``, sorted by prefix) within the budget, by traversing the cut."""
    start, depth = [p << (64 - d) for p, d in leaves], [d for _, d in leaves]

    def within(x: int, y: int, bits: int) -> bool:
        diff = (x ^ y) >> (64 - bits) << (64 - bits)
        return (diff >> 32).bit_count() <= max_bits // 2 and diff.bit_count() <= max_bits

    def halves(lo: int, hi: int, bit: int) -> list[tuple[int, int]]:
        if hi - lo == 1:
            return [(lo, hi)]
        mid = bisect.bisect_left(range(hi), 1, lo, hi, key=lambda i: start[i] >> (63 - bit) & 1)
        return [(x, y) for x, y in ((lo, mid), (mid, hi)) if y > x]

    out, stack = [], [(0, len(leaves), 0, len(leaves), 0)]  # two runs that share their first bits, and how many
    while stack:
        a, b, c, e, bit = stack.pop()
        if not within(start[a], start[c], min(bit, depth[a], depth[c])):
            continue
        if b - a == 1 and e - c == 1:
            if within(start[a], start[c], min(depth[a], depth[c])):
                out.append((a, c))
            continue
        for x in halves(a, b, bit):
            for y in halves(c, e, bit):
                if (a, b) != (c, e) or x <= y:
                    stack.append((*x, *y, bit + 1))
    return out


class _Sets:
    """Disjoint sets with roots as labels, refreshed for all members at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Union all pairs; the pairs that joined two sets (a spanning forest of them)."""
        used_a, used_b = [], []
        a, b = a.copy(), b.copy()
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            roots, first = np.unique(hi, return_index=True)  # each root hooks once a round
            used_a.append(a[first])
            used_b.append(b[first])
            parent = np.arange(len(self.label))
            parent[roots] = lo[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]
        none = np.zeros(0, np.int64)
        return (np.concatenate(used_a) if used_a else none), (np.concatenate(used_b) if used_b else none)


def join_tries(left: np.ndarray, right: np.ndarray | None, max_bits: int = MAX_BITS,
               chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``left`` (right None) or between the two.

    Sorted distinct fingerprints are the trie: a node is a run that shares its
    first bits. Node pairs descend together, a bit a level, in chunks.
    """
    both = left if right is None else np.concatenate([left, right])
    sets, off = _Sets(len(both)), 0 if right is None else len(left)
    out_a, out_b = [], []
    n, m = len(left), len(both) - off
    if not n or not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # runs [a, b) of ``both`` paired with runs [c, e), and the next bit to read
    stack = [(np.array([0]), np.array([n]), np.array([off]), np.array([off + m]), 0)]
    small = 16
    while stack:
        a, b, c, e, bit = stack.pop()
        if len(a) > chunk:
            for i in range(0, len(a), chunk):
                stack.append((a[i:i + chunk], b[i:i + chunk], c[i:i + chunk], e[i:i + chunk], bit))
            continue
        # nodes whose members already are one set
        change = np.concatenate([[0], np.cumsum(sets.label[1:] != sets.label[:-1])])
        one = (change[b - 1] == change[a]) & (change[e - 1] == change[c]) & (sets.label[a] == sets.label[c])
        a, b, c, e = a[~one], b[~one], c[~one], e[~one]
        if not len(a):
            continue
        few = ((b - a) * (e - c) <= small) | (bit >= 64)
        if few.any():
            size = (b - a)[few] * (e - c)[few]
            pair = np.repeat(np.flatnonzero(few), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            x, y = a[pair] + k // (e - c)[pair], c[pair] + k % (e - c)[pair]
            near = (x < y) & ~_over(both[x] ^ both[y], max_bits)
            u, v = sets.link(x[near], y[near])
            out_a.append(both[u])
            out_b.append(both[v])
            a, b, c, e = a[~few], b[~few], c[~few], e[~few]
        if not len(a):
            continue
        ma, mc = _middle(both, a, b, bit), _middle(both, c, e, bit)
        same = (a == c) & (b == e)
        top = np.uint64(63 - bit)
        next_pairs = []
        for lo1, hi1, lo2, hi2, keep in ((a, ma, c, mc, True), (ma, b, mc, e, True),
                                         (a, ma, mc, e, True), (ma, b, c, mc, ~same)):
            on = (hi1 > lo1) & (hi2 > lo2) & keep
            lo1, hi1, lo2, hi2 = lo1[on], hi1[on], lo2[on], hi2[on]
            on = ~_over((both[lo1] ^ both[lo2]) >> top << top, max_bits)
            next_pairs.append((lo1[on], hi1[on], lo2[on], hi2[on]))
        stack.append((*(np.concatenate(x) for x in zip(*next_pairs)), bit + 1))
    return np.concatenate(out_a) if out_a else np.zeros(0, np.uint64), np.concatenate(out_b) if out_b else np.zeros(0, np.uint64)


def _middle(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First place in each sorted run [lo, hi) whose bit ``bit`` (0: highest) is set."""
    lo, hi = lo.copy(), hi.copy()
    mask = np.uint64(1) << np.uint64(63 - bit)
    while True:
        on = lo < hi
        if not on.any():
            return lo
        mid = (lo + hi) >> 1
        one = (fps[np.minimum(mid, len(fps) - 1)] & mask) != 0
        hi = np.where(on & one, mid, hi)
        lo = np.where(on & ~one, mid + 1, lo)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``u, v``: links that connect whatever is linked. ``distinct`` has the distinct fingerprints, as longs ``fp``."""
    leaf_rows = max(leaf_rows, -(-distinct.count() // leaves))
    tries = []
    for order in (0, 1):
        cut = sorted(cut_trie(distinct, order, leaf_rows), key=lambda x: x[0] << (64 - x[1]))
        of: list[list[int]] = [[] for _ in cut]  # each subtrie's pairs: 2 * pair + side
        for k, (x, y) in enumerate(leaf_pairs(cut, max_bits)):
            of[x].append(2 * k)
            if y != x:
                of[y].append(2 * k + 1)
        tries.append((np.array([p << (64 - d) for p, d in cut], np.uint64),
                      np.array([len(x) for x in of]), np.array([t for x in of for t in x], np.int64)))
    shared = distinct.sparkSession.sparkContext.broadcast(tries)

    def deal(batches):
        for batch in batches:
            for order, (start, count, tags) in enumerate(shared.value):
                fp = _turn(batch.column(0).to_numpy().view(np.uint64), order)
                leaf = np.searchsorted(start, fp, side="right") - 1
                tag = tags[ranges((np.cumsum(count) - count)[leaf], count[leaf])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(2 * (tag >> 1) + order), pa.array((tag & 1).astype(np.int8)),
                     pa.array(np.repeat(fp, count[leaf]).view(np.int64))], names=["pair", "side", "fp"])

    def descend(key, table):
        side, fp = table.column("side").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        u, v = join_tries(left, right if len(right) else None, max_bits)  # no other side: a subtrie with itself
        order = key[0].as_py() & 1
        return pa.table({"u": _turn(u, order).view(np.int64), "v": _turn(v, order).view(np.int64)})

    return (distinct.mapInArrow(deal, "pair long, side byte, fp long")
                    .groupBy("pair").applyInArrow(descend, "u long, v long"))


def _components(prints: DataFrame, max_bits: int, leaves: int, leaf_rows: int) -> DataFrame:
    """``fp, component``: each distinct fingerprint with the least one (as a long) it is linked to; written once."""
    distinct = prints.select("fp").distinct()
    edges = stored(links(distinct, max_bits, leaves, leaf_rows), "simhash-links")
    labels = connected_components(edges, checkpoint_every=1).select(F.col("node").alias("fp"), "component")
    return stored(distinct.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")),
                  "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per document. A null doc_id counts as the largest id.

    ``component_id`` names a component by its smallest id; where ids repeat, several components can have one name.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    joined = first.join(_components(prints, max_bits, leaves, leaf_rows), "fp")
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = stored(joined.join(smallest, "component").select("fp", "component_id", "n"), "simhash-names")
    # fingerprints of over a thousandth of the rows, at most a thousand, are broadcast; the others meet by shuffle
    hot = F.col("n") > max(1, prints.count() // HOT_SHARE)
    rows = prints.join(F.broadcast(of.where(hot).select("fp", F.struct("component_id").alias("_of"))), "fp", "left")
    found = rows.where(F.col("_of").isNotNull()).select("doc_id", "fp", "_of.component_id").unionByName(
        rows.where(F.col("_of").isNull()).drop("_of").join(of.where(~hot).drop("n"), "fp").select("doc_id", "fp", "component_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_digest(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row; nulls count by their place."""
    plain = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in docs.schema]
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in docs.columns])
    return [F.xxhash64(F.lit(i), *plain, nulls).alias(f"_h{i}") for i in (1, 2)]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
             leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``docs`` with one row of each component: one with the component's smallest id.

    Components are told apart by their fingerprints, so an id that several of them share keeps one row in each. Of several
    rows of a component with its smallest id, the one with the least hash of the whole row stays. Rows without an id stay
    only if their whole component has none; one row of it does.

    The choice is made on ids, fingerprints and row hashes; texts are shuffled once, by row hash. Rows that are equal in all
    columns share a hash; those that repeat in over a thousandth of all rows are merged before the shuffle.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = plain.select(*names, *_row_digest(plain))
    prints = stored(fingerprints(rows, key, text, shingle, ["_h1", "_h2"]), "simhash-rows")
    counted = prints.groupBy("_h1", "_h2", "doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h1", "_h2", "n")).alias("best")
    per_print = counted.groupBy("fp").agg(least)  # copies are one row a fingerprint before they are joined
    kept = stored(per_print.join(_components(prints, max_bits, leaves, leaf_rows), "fp").groupBy("component").agg(F.min("best").alias("best"))
                           .select("best._h1", "best._h2", "best.n"), "simhash-kept")
    hot = F.col("n") > max(1, prints.count() // HOT_SHARE)  # at most a thousand
    marked = rows.join(F.broadcast(kept.where(hot).select("_h1", "_h2", F.lit(True).alias("_hot"))), ["_h1", "_h2"], "left")
    one = F.first(F.struct(*names)).alias("_row")  # of rows that are equal in all columns
    cold = marked.where(F.col("_hot").isNull()).join(kept.where(~hot), ["_h1", "_h2"])
    repeated = cold.where("n > 1").groupBy("_h1", "_h2").agg(one).unionByName(marked.where("_hot").groupBy("_h1", "_h2").agg(one))
    return cold.where("n = 1").select(*names).unionByName(repeated.select("_row.*")).toDF(*docs.columns)
