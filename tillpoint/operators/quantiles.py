"""Exact, linearly interpolated quantiles (A12, O1, T3, P2, A6 median) by bracketed selection.

No row is sorted and the table is not exchanged:

1. a sketch (``percentile_approx``, partial sketches before the shuffle) cuts
   every column of every group into ``CUTS`` slices of about equal counts; the
   slices about a quantile's place are its bracket;
2. one pass counts the rows below and above each bracket and, inside it, the
   rows of each value, all with partial aggregation: only bracket values leave
   the tasks;
3. a bracket of more than ``MOST_VALUES`` values is cut again by a sketch of
   its own rows, as often as it takes (each time by about ``CUTS`` / 3);
4. running counts over the bracket's values give the two ranks around
   ``p·(n−1)``, interpolated like pandas / DuckDB ``quantile_cont`` / Spark
   ``percentile``. The nearest values outside are kept too, for a rank that
   falls just beside the bracket. The counts prove that the ranks are inside;
   if a sketch erred more than it may, the bracket is widened.

The needed columns are persisted for the passes and released at the end.
NULL and NaN are ignored (pandas skips missing values).
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.session import cut_lineage

CUTS = 128
ACCURACY = 10_000
MOST_VALUES = 1 << 20
_INF = float("inf")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def _with_groups(rows: DataFrame, table: DataFrame, groups: list[str]) -> DataFrame:
    """``rows`` with their group's columns of ``table`` (one row per group; null is a group)."""
    if not groups:
        return rows.crossJoin(F.broadcast(table))  # one row
    named = table.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    return rows.join(named, _same(groups, [f"_g_{g}" for g in groups])).drop(*[f"_g_{g}" for g in groups])


def _cut(slice_: Column, margin: int, cuts: int, lo: Column | None = None, hi: Column | None = None) -> list[Column]:
    """Bracket bounds ``margin`` cuts about a slice; ``lo`` and ``hi`` (or infinite) beyond the cuts."""
    low, high = slice_.cast("int") - margin, slice_.cast("int") + margin + 1
    return [F.when(low > 0, F.get("cuts", low)).otherwise(F.lit(-_INF) if lo is None else lo).alias("lo"), F.when(high < cuts, F.get("cuts", high)).otherwise(F.lit(_INF) if hi is None else hi).alias("hi")]


def _counted(narrow: DataFrame, brackets: DataFrame, groups: list[str], value_cols: list[str]) -> DataFrame:
    """For each bracket: rows below (place 0), of each value inside (1) and above (2), with the nearest values outside."""
    listed = brackets.groupBy(*groups).agg(F.collect_list(F.struct("column", "prob", "n", "lo", "hi")).alias("_b"))
    value = reduce(lambda e, c: F.when(F.col("_x.column") == c, F.col(f"`{c}`")).otherwise(e), value_cols, F.lit(None).cast("double"))
    rows = _with_groups(narrow, listed, groups).select(*groups, "_w", *[f"`{c}`" for c in value_cols], F.explode("_b").alias("_x"))
    rows = rows.select(*groups, "_w", "_x.*", value.alias("_v")).where(F.col("_v").isNotNull())
    place = F.when(F.col("_v") < F.col("lo"), 0).when(F.col("_v") <= F.col("hi"), 1).otherwise(2)
    return rows.withColumn("_place", place).groupBy(
        *groups, "column", "prob", "n", "lo", "hi", "_place", F.when(F.col("_place") == 1, F.col("_v")).alias("_in")).agg(
        F.sum("_w").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))


def exact_quantiles(df: DataFrame, value_cols: list[str], probs: list[float],
                    group_cols: list[str] | None = None, weight_col: str | None = None,
                    cuts: int = CUTS, most_values: int = MOST_VALUES) -> DataFrame:
    """Long result: ``group_cols…, column, prob, value``; no row for a column without values in a group.

    ``weight_col`` (integer) counts each row that many times.
    """
    groups = list(group_cols or [])
    keys = groups + ["column", "prob"]
    plain = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(c) for c in value_cols]
    narrow = df.select(*groups, *plain, (F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")).alias("_w"))
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    repeated = narrow if not weight_col else narrow.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_w"))))
    grid = [i / cuts for i in range(cuts + 1)]
    per_prob = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")

    margin = 1
    sketch = cut_lineage(repeated.groupBy(*groups).agg(*[F.struct(
        F.lit(c).alias("column"), F.count(f"`{c}`").alias("n"), F.percentile_approx(f"`{c}`", grid, ACCURACY).alias("cuts")).alias(c)
        for c in value_cols]).select(*groups, F.explode(F.array(*[f"`{c}`" for c in value_cols])).alias("_s"))
        .select(*groups, "_s.*").where("n > 0"), "checkpoint")
    while True:
        brackets = sketch.select(*groups, "column", "n", "cuts", per_prob)
        brackets = brackets.select(*keys, "n", *_cut(F.floor(F.col("prob") * cuts), margin, cuts))
        while True:
            hist = cut_lineage(_counted(narrow, brackets, groups, value_cols), "checkpoint")
            below = F.coalesce(F.sum(F.when(F.col("_place") == 0, F.col("_c"))), F.lit(0))
            inside = F.coalesce(F.sum(F.when(F.col("_place") == 1, F.col("_c"))), F.lit(0))
            state = hist.groupBy(*keys, "n", "lo", "hi").agg(below.alias("below"), inside.alias("inside"),
                                                             F.count("_in").alias("values"))
            rank = F.col("prob") * (F.col("n") - 1)
            missed = (F.floor(rank) < F.col("below") - 1) | (F.ceil(rank) > F.col("below") + F.col("inside"))
            wrong, most = state.agg(F.count(F.when(missed, 1)), F.max("values")).first()
            if wrong or (most or 0) <= most_values:
                break
            # cut the large brackets again by their own rows
            large = state.where(F.col("values") > most_values)
            named = large.withColumnsRenamed({k: f"_k_{k}" for k in keys}).drop("n", "values").withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
            again = hist.where("_place = 1").join(named, _same(keys, [f"_k_{k}" for k in keys]))
            again = again.groupBy(*keys, "below", "_lo", "_hi").agg(F.percentile_approx("_in", grid, ACCURACY).alias("cuts"))
            # slices are of values, not rows: find the place by the rows below each cut
            held = hist.where("_place = 1").join(again.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys, [f"_k_{k}" for k in keys]))
            held = held.groupBy(*keys, "n", "below", "_lo", "_hi", "cuts").agg(*[F.sum(F.when(F.col("_in") <= F.get("cuts", F.lit(i)), F.col("_c")).otherwise(0)).alias(f"_u{i}")
                                                                   for i in range(cuts + 1)])
            upto = F.array(*[f"_u{i}" for i in range(cuts + 1)])
            slice_ = F.size(F.filter(upto, lambda u: u + F.col("below") <= F.floor(rank)))
            narrower = held.select(*keys, "n", *_cut(slice_, margin, cuts, F.col("_lo"), F.col("_hi")))
            brackets = cut_lineage(state.where(F.col("values") <= most_values).select(*keys, "n", "lo", "hi").unionByName(narrower), "checkpoint")
        if not wrong:
            break
        margin *= 4
    narrow.unpersist()

    # the nearest values outside hold the ranks just beside the bracket
    ranked = hist.select(*keys, "n", "_place", F.when(F.col("_place") == 0, F.col("_max")).when(F.col("_place") == 2, F.col("_min"))
                         .otherwise(F.col("_in")).alias("_v"), "_c")
    before = Window.partitionBy(*keys).orderBy("_place", "_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("_lo", F.coalesce(F.sum("_c").over(before), F.lit(0)))
                    .withColumn("_hi", F.col("_lo") + F.col("_c") - 1)
                    .withColumn("_pos", F.col("prob") * (F.col("n") - 1)))
    first = F.when(F.col("_place") == 2, F.col("_lo")).otherwise(F.col("_hi"))  # of an outer row, the rank next to the bracket
    last = F.when(F.col("_place") == 0, F.col("_hi")).otherwise(F.col("_lo"))
    has = lambda rk: rk.between(F.least(first, last), F.greatest(first, last))
    has0, has1 = has(F.floor("_pos")), has(F.ceil("_pos"))
    picked = ranked.where(has0 | has1).groupBy(*keys).agg(
        F.max(F.when(has0, F.col("_v"))).alias("_v0"), F.max(F.when(has1, F.col("_v"))).alias("_v1"), F.first("_pos").alias("_pos"))
    return picked.select(*keys, (F.col("_v0") + (F.col("_pos") - F.floor("_pos")) * (F.col("_v1") - F.col("_v0"))).alias("value"))
