"""Exact k-distance (G4): distance of every point to its k-th nearest point,
the point itself counted first (query points = fitted points).

* Equal points collapse to one weighted point.
* Points are range-partitioned along a space-filling order, a leaf of about
  ``LEAF_POINTS`` points each: cells of many sizes, small where points are
  dense. The order's bits come from approximate quantiles of each coordinate,
  so neither a far outlier nor a dense spot makes leaves uneven.
* In its leaf each point finds its k nearest (``runs.py``: boxes over runs of
  the order, about log n work a point).
* A point whose ball of that radius reaches the box of another leaf searches
  all leaves it reaches, with the radius as bound; the boxes (at most ``MOST_LEAVES`` rows, checked)
  go to all tasks. The k nearest of all visits are merged by point.

Partition keys lead the order; a leaf may hold many small keys, and distances
are only taken within a key. Visitors of one leaf are dealt to as many tasks as
their number asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.cluster.runs import Runs, interleaved
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.operators.rowindex import with_row_index
from tillpoint.session import cut_lineage

LEAF_POINTS = 4096
MOST_LEAVES = 1 << 16  # beyond it leaves grow
BREAKS = 1023
VISITORS = 1 << 16  # of a leaf that one task takes


def _nearest(runs: Runs, order: np.ndarray, key: np.ndarray, x: np.ndarray, w: np.ndarray, k: int,
             bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, squared distance, weight) of the fewest nearest points that weigh k or more, by query, and the bounds."""
    q, i, d2, bound = runs.near(key, x, k, bound)
    near = np.lexsort((d2, q))
    q, i, d2 = q[near], i[near], d2[near]
    weight = w[order][i]
    if len(q):
        total = np.cumsum(weight) - weight
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        needed = total - np.repeat(total[head], np.diff(np.append(head, len(q)))) < k
        q, d2, weight = q[needed], d2[needed], weight[needed]
    return q, d2, weight, bound


def _sorted_runs(key, code, x, w) -> tuple[Runs, np.ndarray]:
    order = np.lexsort((code, key))
    return Runs(key[order], x[order], None, w[order]), order


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], axis=1)


def _within_leaves(points: DataFrame, xs: list[str], k: int, breaks: np.ndarray, leaves: int) -> DataFrame:
    """``points`` (key_no, pid, w, x…) with ``leaf``, ``code``, ``kth2`` (null: the leaf holds too few)."""
    def coded(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in xs], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(interleaved(x, breaks))], names=[*batch.schema.names, "code"])

    def search(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key, code, w, x = (table.column("key_no").to_numpy(), table.column("code").to_numpy(), table.column("w").to_numpy(), _matrix(table, xs))
        runs, _ = _sorted_runs(key, code, x, w)
        bound = runs.near(key, x, k)[3]
        out = table.append_column("leaf", pa.array(np.full(len(x), leaf_number(), np.int64))) \
                   .append_column("kth2", pa.array(bound, mask=np.isinf(bound)))
        yield from out.to_batches(max_chunksize=1 << 14)

    def leaf_number() -> int:
        return TaskContext.get().partitionId()

    columns = "key_no long, pid long, w long, " + "".join(f"{x} double, " for x in xs) + "code long"
    ranged = points.select("key_no", "pid", F.col("w").cast("long"), *xs).mapInArrow(coded, columns) \
                   .repartitionByRange(leaves, "key_no", "code")
    # written once: a leaf's number is its partition's
    return cut_lineage(ranged.mapInArrow(search, columns + ", leaf long, kth2 double"), "checkpoint")


def _visits(found: DataFrame, xs: list[str], k: int) -> DataFrame | None:
    """``leaf, key_no, pid, x…, bound``: points whose balls reach other leaves, with all leaves they reach; None if there is one leaf."""
    lo, hi = [F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)], [F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]
    boxes = found.groupBy("leaf").agg(F.min("key_no").alias("k0"), F.max("key_no").alias("k1"), F.sum("w").alias("w"), *lo, *hi) \
                 .orderBy("leaf").collect()  # at most MOST_LEAVES rows
    if len(boxes) < 2:
        return None
    d = len(xs)
    leaf = np.array([b.leaf for b in boxes])
    tree = Runs(np.array([[b.k0, b.k1] for b in boxes]), np.array([[b[f"lo{i}"] for i in range(d)] for b in boxes]),
                np.array([[b[f"hi{i}"] for i in range(d)] for b in boxes]), np.array([b.w for b in boxes]), run=8)

    def route(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = table.column("leaf").to_numpy()
            bound = np.nan_to_num(table.column("kth2").to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf)
            q, i, gap, least = tree.near(table.column("key_no").to_numpy(), _matrix(table, xs), k, bound)
            # a point as far as the k-th one of its own leaf changes nothing
            reached = (gap < least[q]) | ((gap == least[q]) & (least < bound)[q])
            away = reached & (leaf[i] != own[q])
            travels = np.zeros(len(own), bool)
            travels[q[away]] = True
            go = away | (travels[q] & (leaf[i] == own[q]))
            part = batch.select(["key_no", "pid", *xs]).take(pa.array(q[go]))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[i[go]]), *part.columns, pa.array(least[q[go]])],
                                             names=["leaf", "key_no", "pid", *xs, "bound"])

    return found.select("leaf", "key_no", "pid", *xs, "kth2").mapInArrow(
        route, "leaf long, key_no long, pid long, " + "".join(f"{x} double, " for x in xs) + "bound double")


def k_distance(df: DataFrame, feature_cols: list[str], k: int = 5, id_col: str = "row_idx",
               keys: list[str] | None = None, leaf_points: int = LEAF_POINTS, visitors: int = VISITORS) -> DataFrame:
    """Per distinct point: ``keys…, pid, x0…, w, kdist`` (``w`` = rows at that point).

    ``kdist`` is null where the partition key holds fewer than ``k`` rows.
    """
    keys = list(keys or [])
    xs = [f"x{i}" for i in range(len(feature_cols))]
    pts = (df.select(*keys, F.col(id_col).cast("long").alias("_id"),
                     *[F.col(c).cast("double").alias(x) for c, x in zip(feature_cols, xs)])
             .groupBy(*keys, *xs).agg(F.count(F.lit(1)).alias("w"), F.min("_id").alias("pid")))
    pts = cut_lineage(pts, "persist")
    if keys:
        number = with_row_index(pts.select(*keys).distinct(), keys, "key_no")
        same = None
        for c in keys:
            one = F.col(f"_k_{c}").eqNullSafe(F.col(c))
            same = one if same is None else same & one
        points = pts.join(number.select("key_no", *[F.col(c).alias(f"_k_{c}") for c in keys]), same).drop(*[f"_k_{c}" for c in keys])
    else:
        points = pts.withColumn("key_no", F.lit(0).cast("long"))
    cuts = [F.percentile_approx(x, [(i + 1) / (BREAKS + 1) for i in range(BREAKS)], 4 * BREAKS).alias(x) for x in xs]
    row = points.agg(F.count(F.lit(1)).alias("n"), *cuts).first()
    if not row.n:
        return pts.withColumn("kdist", F.lit(None).cast("double")).select(*keys, "pid", *xs, "w", "kdist")
    breaks = [np.unique(np.array(row[x], np.float64)) for x in xs]
    leaves = max(1, min(MOST_LEAVES, -(-row.n // leaf_points)))
    found = _within_leaves(points, xs, k, breaks, leaves)
    result = found.select("key_no", "pid", "w", *xs, "kth2")

    visits = _visits(found, xs, k)
    if visits is not None:
        visits = cut_lineage(visits, "checkpoint")
        parts = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("long").alias("parts"))
        guests = visits.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("pid", "key_no"), F.col("parts"))).drop("parts")
        hosts = found.select("leaf", "key_no", "code", "w", *xs).join(parts, "leaf") \
                     .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            none = pa.table({"key_no": pa.array([], pa.int64()), "pid": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "w": pa.array([], pa.int64())})
            if not left.num_rows or not right.num_rows:
                return none
            w = right.column("w").to_numpy()
            runs, order = _sorted_runs(right.column("key_no").to_numpy(), right.column("code").to_numpy(), _matrix(right, xs), w)
            q, d2, weight, _ = _nearest(runs, order, left.column("key_no").to_numpy(), _matrix(left, xs), w, k, left.column("bound").to_numpy())
            return pa.table({"key_no": left.column("key_no").take(pa.array(q)), "pid": left.column("pid").take(pa.array(q)),
                             "d2": pa.array(d2), "w": pa.array(weight)})

        seen = guests.groupBy("leaf", "part").cogroup(hosts.groupBy("leaf", "part")).applyInArrow(visit, "key_no long, pid long, d2 double, w long")
        step = lambda a, e: F.struct((a["cum"] + e["w"]).alias("cum"), F.when(
            (a["cum"] < k) & (a["cum"] + e["w"] >= k), e["d2"]).otherwise(a["kth2"]).alias("kth2"))
        merged = seen.groupBy("key_no", "pid").agg(F.array_sort(F.collect_list(F.struct("d2", "w"))).alias("near")).select(
            "key_no", "pid", F.aggregate("near", F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("double").alias("kth2")), step)["kth2"].alias("best"))
        result = result.join(merged.select("key_no", "pid", F.struct("best").alias("_m")), ["key_no", "pid"], "left") \
                       .withColumn("kth2", F.when(F.col("_m").isNotNull(), F.col("_m.best")).otherwise(F.col("kth2")))
    if keys:
        result = result.join(number, "key_no")
    return result.select(*keys, "pid", *xs, "w", F.sqrt("kth2").alias("kdist"))


def k_distance_rows(df: DataFrame, feature_cols: list[str], k: int = 5,
                    id_col: str = "row_idx", keys: list[str] | None = None) -> DataFrame:
    """Every input row with its ``kdist`` (equal points share one value)."""
    keys = list(keys or [])
    kd = k_distance(df, feature_cols, k, id_col, keys).select(
        *[F.col(kk).alias(f"_pk_{kk}") for kk in keys],
        *[F.col(f"x{i}").alias(f"_px{i}") for i in range(len(feature_cols))], "kdist")
    rows = df.withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(feature_cols)})
    cond = [F.col(kk) == F.col(f"_pk_{kk}") for kk in keys] + \
           [F.col(f"_x{i}") == F.col(f"_px{i}") for i in range(len(feature_cols))]
    return rows.join(kd, cond, "left").select(*[F.col(f"`{c}`") for c in df.columns], "kdist")


def k_distance_curve(kd: DataFrame, points: int | None = None) -> DataFrame:
    """The ascending k-distance curve (``rank``, ``distance``) over all rows.

    ``points=None`` gives every row (rank 0…n−1, distributed sort);
    otherwise ``points`` evenly spaced exact quantiles thin the curve.
    """
    if points is None:
        expanded = kd.select("pid", "kdist", F.explode(F.array_repeat(F.lit(0), F.col("w").cast("int"))).alias("_"))
        return with_row_index(expanded.select("pid", "kdist").withColumn("_dup", F.monotonically_increasing_id()),
                              ["kdist", "pid", "_dup"], col="rank").select("rank", F.col("kdist").alias("distance"))
    probs = [i / (points - 1) for i in range(points)] if points > 1 else [0.5]
    q = exact_quantiles(kd, ["kdist"], probs, weight_col="w")
    return q.select(F.col("prob").alias("fraction"), F.col("value").alias("distance"))
