"""Exact DBSCAN on a grid (G5, J3), optionally per partition key.

Semantics (those of the usual library implementation): the ε-neighbourhood
uses distance ≤ ε and counts the point itself; a core point has at least
``min_samples`` points in it; clusters are the connected components of core
points joined by ε-edges, numbered from 0 per partition key in the order of
their lowest row position; a non-core point with core neighbours (border)
takes the lowest cluster number among them; the rest is noise (−1).

Plan (after Gunawan 2013 and Gan & Tao 2015, grid DBSCAN):

1. equal points collapse to one weighted point (min row position kept);
2. grid of side ε/√d: a cell's points are all mutual neighbours, so a *heavy*
   cell (weight ≥ min_samples) makes all of them core with no distance work.
   Heavy cells (one row each) and the fewer than min_samples points of each
   light cell go to tiles of the grid (``tiles.py``), where light points count
   their neighbours: a heavy cell whose box lies wholly inside the ε-ball adds
   its weight; only points still undecided open cells that straddle it;
3. link grid of side ε/√(d+3), on which face-adjacent cells are always within
   ε: its core cells are linked in tiles by their core bounding boxes (farthest
   corners within ε: linked; nearest beyond ε: not). A tile sends one edge a
   cell and the pairs its own links leave open; components of the edges come
   from star rounds over all tiles;
4. open pairs that still join *different* components are decided by a descent
   on both cells' boxes (``closest_within``): pairs of sub-boxes are dropped by
   their gap, accepted by their far corners, split otherwise. No pair of whole
   cells is ever joined point by point;
5. cluster numbers = rank of each component's lowest row position per key;
   border points take the minimum over their core neighbours' cells (a cell's
   core points are one cluster), opening only cells that could lower it.

No group holds more than a tile's cells and light points or one box pair of
bounded size; a hot cell's points are only ever split or filtered.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.cluster import tiles
from tillpoint.cluster.components import components_by_leaves
from tillpoint.cluster.local import dbscan_group
from tillpoint.operators.rowindex import with_row_index
from tillpoint.session import cut_lineage

DIRECT = 4096  # point pairs of two boxes that are compared at once
GROUP_ROWS = 1 << 17  # rows of a key that one task labels by itself


def _dist2(a: list[str], b: list[str]) -> Column:
    return reduce(Column.__add__, [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)])


def _gap2(alo, ahi, blo, bhi) -> Column:
    gaps = [F.greatest(F.col(bl) - F.col(ah), F.col(al) - F.col(bh), F.lit(0.0)) for al, ah, bl, bh in zip(alo, ahi, blo, bhi)]
    return reduce(Column.__add__, [g * g for g in gaps])


def _far2(alo, ahi, blo, bhi) -> Column:
    fars = [F.greatest(F.col(bh) - F.col(al), F.col(ah) - F.col(bl)) for al, ah, bl, bh in zip(alo, ahi, blo, bhi)]
    return reduce(Column.__add__, [f * f for f in fars])


def _names(prefix: str, d: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def _box(d: int, x: str = "x") -> list[Column]:
    return [F.min(f"{x}{i}").alias(f"lo{i}") for i in range(d)] + [F.max(f"{x}{i}").alias(f"hi{i}") for i in range(d)]


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], axis=1)


def _per_tile(rows: DataFrame, keys: list[str], d: int, reach: int, out: str, work) -> DataFrame:
    """``work(table) -> dict of columns`` on each tile's rows; the keys are put before its columns."""
    spread = tiles.over_tiles(rows, _names("c", d), reach, tiles.tile_width(d, reach))
    key_types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema) if keys else ""

    def run(table: pa.Table) -> pa.Table:
        columns = work(table)
        n = len(next(iter(columns.values())))
        first = {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}
        return pa.table({**first, **columns})

    return spread.groupBy(*keys, *_names("t", d)).applyInArrow(run, key_types + out)


def _core_of_light(heavy: DataFrame, light: DataFrame, keys: list[str], d: int, reach: int, eps: float, min_samples: int) -> DataFrame:
    """``pid, n`` (weight found), ``node`` (a heavy cell to open; null: n is the count's verdict) for light points."""
    lo, hi, c = _names("lo", d), _names("hi", d), _names("c", d)
    rows = heavy.select(*keys, F.lit(True).alias("cell"), F.col("node").alias("id"), F.col("w"), *c, *lo, *hi).unionByName(
        light.select(*keys, F.lit(False).alias("cell"), F.col("pid").alias("id"), "w", *c,
                     *[F.col(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.col(f"x{i}").alias(f"hi{i}") for i in range(d)]))

    def work(table):
        is_cell = table.column("cell").to_numpy(zero_copy_only=False)
        ids, w, at = table.column("id").to_numpy(), table.column("w").to_numpy(), _matrix(table, c)
        low, high = _matrix(table, lo), _matrix(table, hi)
        own = np.flatnonzero(table.column("owner").to_numpy(zero_copy_only=False)[~is_cell])
        found, q, j = tiles.count_neighbours(at[is_cell], low[is_cell], high[is_cell], w[is_cell], at[~is_cell], low[~is_cell],
                                             w[~is_cell], own, reach, eps, min_samples, d)
        pid, node = ids[~is_cell][own], ids[is_cell]
        settled = np.ones(len(own), bool)
        settled[q] = False
        settled = np.flatnonzero(settled)
        return {"pid": pa.array(np.concatenate([pid[settled], pid[q]])), "n": pa.array(np.concatenate([found[settled], found[q]])),
                "node": pa.array(np.concatenate([np.zeros(len(settled), np.int64), node[j]]),
                                 mask=np.arange(len(settled) + len(q)) < len(settled))}

    return _per_tile(rows, keys, d, reach, "pid long, n long, node long", work)


def _linked_cells(cells: DataFrame, keys: list[str], d: int, reach: int, eps: float) -> DataFrame:
    """``u, v, sure``: links between core cells by their boxes, and open pairs."""
    lo, hi, c = _names("lo", d), _names("hi", d), _names("c", d)

    def work(table):
        table = table.sort_by("node")  # least number: least node
        node = table.column("node").to_numpy()
        label, a, b = tiles.link_cells(_matrix(table, c), _matrix(table, lo), _matrix(table, hi),
                                       table.column("owner").to_numpy(zero_copy_only=False), reach, eps, d + 3)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return {"u": pa.array(np.concatenate([node[moved], node[a]])), "v": pa.array(np.concatenate([node[label[moved]], node[b]])),
                "sure": pa.array(np.arange(len(moved) + len(a)) < len(moved))}

    return _per_tile(cells.select(*keys, "node", *c, *lo, *hi), keys, d, reach, "u long, v long, sure boolean", work)


def _border_labels(cells: DataFrame, points: DataFrame, keys: list[str], d: int, reach: int, eps: float) -> DataFrame:
    """``pid, cl, node``: the least cluster of cells wholly within ε (node null), and cells to open for a lower one."""
    lo, hi, c = _names("lo", d), _names("hi", d), _names("c", d)
    rows = cells.select(*keys, F.lit(True).alias("cell"), F.col("node").alias("id"), F.col("cl").cast("long").alias("cl"), *c, *lo, *hi).unionByName(
        points.select(*keys, F.lit(False).alias("cell"), F.col("pid").alias("id"), F.lit(0).cast("long").alias("cl"), *c,
                      *[F.col(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.col(f"x{i}").alias(f"hi{i}") for i in range(d)]))

    def work(table):
        is_cell = table.column("cell").to_numpy(zero_copy_only=False)
        mine = ~is_cell & table.column("owner").to_numpy(zero_copy_only=False)
        ids, label, at = table.column("id").to_numpy(), table.column("cl").to_numpy(), _matrix(table, c)
        low, high = _matrix(table, lo), _matrix(table, hi)
        best, q, j = tiles.least_label(at[is_cell], low[is_cell], high[is_cell], label[is_cell], at[mine], low[mine], reach, eps, d + 3)
        pid, has = ids[mine], np.flatnonzero(best < np.iinfo(np.int64).max)
        return {"pid": pa.array(np.concatenate([pid[has], pid[q]])), "cl": pa.array(np.concatenate([best[has], label[is_cell][j]])),
                "node": pa.array(np.concatenate([np.zeros(len(has), np.int64), ids[is_cell][j]]), mask=np.arange(len(has) + len(q)) < len(has))}

    return _per_tile(rows, keys, d, reach, "pid long, cl long, node long", work)


def closest_within(pairs: DataFrame, points: DataFrame, keys: list[str], d: int, eps: float, direct: int = DIRECT) -> DataFrame:
    """``a, b`` of those ``pairs`` (keys…, a, b) of groups that have points (keys…, node, pid, x…) within ε of each other.

    Both groups' boxes descend together. A pair of boxes is dropped if its gap is beyond ε, and accepts its groups if
    its far corners are within ε. Pairs of at most ``direct`` point pairs are compared; others split both boxes (in two
    along each dimension, in four of one or two dimensions). Each round touches the points of open boxes only.
    """
    e2 = F.lit(eps * eps)
    parts = 4 if d <= 2 else 2
    xs, lo, hi = _names("x", d), _names("lo", d), _names("hi", d)
    sides = [(_names(f"{s}lo", d), _names(f"{s}hi", d)) for s in "ab"]
    needed = pairs.select(*keys, F.col("a").alias("node")).unionByName(pairs.select(*keys, F.col("b").alias("node"))).distinct()
    pts = cut_lineage(points.select(*keys, "node", "pid", *xs).join(needed, keys + ["node"], "left_semi").withColumn("box", F.col("node")), "checkpoint")
    frontier = pairs.select(*keys, "a", "b", F.col("a").alias("abox"), F.col("b").alias("bbox"))
    accepted = None
    while True:
        boxes = pts.groupBy(*keys, "box").agg(F.count(F.lit(1)).alias("n"), *_box(d))
        side = {s: boxes.select(*keys, F.col("box").alias(f"{s}box"), F.col("n").alias(f"{s}n"), *[F.col(l).alias(f"{s}{l}") for l in lo],
                                *[F.col(h).alias(f"{s}{h}") for h in hi]) for s in "ab"}
        met = frontier.join(side["a"], keys + ["abox"]).join(side["b"], keys + ["bbox"]) \
                      .where(_gap2(*sides[0], *sides[1]) <= e2) \
                      .withColumn("sure", _far2(*sides[0], *sides[1]) <= e2)
        met = cut_lineage(met, "checkpoint")
        sure = met.where("sure").select(*keys, "a", "b")
        left = met.where("not sure")
        few = left.where(F.col("an") * F.col("bn") <= direct)
        pa_, pb = (pts.select(*keys, F.col("box").alias(f"{s}box"), *[F.col(x).alias(f"{s}{x}") for x in xs]) for s in "ab")
        close = few.select(*keys, "a", "b", "abox", "bbox").join(pa_, keys + ["abox"]).join(pb, keys + ["bbox"]) \
                   .where(_dist2([f"a{x}" for x in xs], [f"b{x}" for x in xs]) <= e2).select(*keys, "a", "b")
        found = sure.unionByName(close).distinct()
        accepted = cut_lineage(found if accepted is None else accepted.unionByName(found).distinct(), "checkpoint")
        left = left.where(F.col("an") * F.col("bn") > direct).join(accepted, keys + ["a", "b"], "left_anti")
        left = cut_lineage(left.select(*keys, "a", "b", "abox", "bbox"), "checkpoint")
        if left.isEmpty():
            return accepted
        # children: numbered by their least pid, which is one of their box's points and so unique
        open_ = left.select(*keys, F.col("abox").alias("box")).unionByName(left.select(*keys, F.col("bbox").alias("box"))).distinct()
        cut = pts.join(boxes.join(open_, keys + ["box"], "left_semi").select(*keys, "box", *lo, *hi), keys + ["box"])
        part = [F.when(F.col(h) > F.col(l), F.least(F.floor((F.col(x) - F.col(l)) / (F.col(h) - F.col(l)) * parts), F.lit(parts - 1)))
                 .otherwise(0).cast("int").alias(f"s{i}") for i, (x, l, h) in enumerate(zip(xs, lo, hi))]
        cut = cut.select(*keys, "node", "pid", *xs, F.col("box").alias("parent"), *part)
        named = cut.groupBy(*keys, "parent", *_names("s", d)).agg(F.min("pid").alias("box"))
        pts = cut_lineage(cut.join(named, keys + ["parent", *_names("s", d)]).select(*keys, "node", "pid", *xs, "parent", "box"), "checkpoint")
        child = pts.select(*keys, "parent", "box").distinct()
        frontier = left.join(child.select(*keys, F.col("parent").alias("abox"), F.col("box").alias("abox2")), keys + ["abox"]) \
                       .join(child.select(*keys, F.col("parent").alias("bbox"), F.col("box").alias("bbox2")), keys + ["bbox"]) \
                       .select(*keys, "a", "b", F.col("abox2").alias("abox"), F.col("bbox2").alias("bbox"))


def _by_group(df: DataFrame, feature_cols: list[str | Column], eps: float, min_samples: int, id_col: str,
              keys: list[str], out_col: str, drop: list[str]) -> DataFrame:
    """``dbscan`` with all rows of a key in one task, stored."""
    features = _names("_x", len(feature_cols))
    rows = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = rows.withColumns({f: (F.col(c) if isinstance(c, str) else c).cast("double") for c, f in zip(feature_cols, features)}).drop(*drop)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label = dbscan_group(_matrix(table, features), table.column(id_col).to_numpy(), eps, min_samples)
        return table.drop_columns(features).append_column(out_col, pa.array(label, pa.int32()))

    kept = df.drop(*drop).schema
    return cut_lineage(rows.groupBy(*keys).applyInArrow(run, T.StructType([*kept.fields, T.StructField(out_col, T.IntegerType())])), "table")


def dbscan(df: DataFrame, feature_cols: list[str | Column], eps: float = 0.5, min_samples: int = 5,
           id_col: str = "row_idx", keys: list[str] | None = None,
           out_col: str = "Cluster", drop: list[str] | None = None, most_rows: int | None = None) -> DataFrame:
    """Label every row of ``df`` (all columns but those of ``drop`` kept) with ``out_col``.

    ``id_col`` gives the row position used for numbering; it must be unique
    within each key. Features are columns or expressions, non-null; expressions are computed
    on both sides of the rows' exchange, so that it carries only their inputs (``drop`` names those of no further use).
    ``most_rows`` says how many rows a key has at most: keys of up to ``GROUP_ROWS`` are labelled in one task each
    (``local.py``), after one exchange and with no tables in between.
    """
    keys = list(keys or [])
    d = len(feature_cols)
    if keys and most_rows is not None and most_rows <= GROUP_ROWS:
        return _by_group(df, feature_cols, eps, min_samples, id_col, keys, out_col, drop or [])
    # cells a hair smaller than the bound, so floating-point rounding in the
    # cell ids can never put two points more than ε apart in one cell
    side, link_side = (eps / math.sqrt(n) * (1 - 1e-9) for n in (d, d + 3))
    reach, link_reach = math.floor(eps / side) + 1, math.floor(eps / link_side) + 1
    xs, cs, lo, hi = _names("x", d), _names("c", d), _names("lo", d), _names("hi", d)

    # the rows go to their cells once: points, cells and the way back to the rows share this exchange
    features, at = [f"_{x}" for x in xs], [f"_{c}" for c in cs]
    value = {f: (F.col(c) if isinstance(c, str) else c).cast("double") for c, f in zip(feature_cols, features)}
    place = {c: F.floor(value[f] / F.lit(side)).cast("long") for c, f in zip(at, features)}
    rows = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *place.values())
    rows = cut_lineage(rows.withColumns(value | place).drop(*(drop or [])), "persist")

    # 1. weighted distinct points and their cells; a cell is named by its least pid
    pts = (rows.select(*keys, F.col(id_col).cast("long").alias("_id"), *[F.col(f).alias(x) for f, x in zip(features, xs)],
                       *[F.col(c).alias(n) for c, n in zip(at, cs)])
               .groupBy(*keys, *cs, *xs).agg(F.count(F.lit(1)).alias("w"), F.min("_id").alias("pid")))
    cells = pts.groupBy(*keys, *cs).agg(F.min("pid").alias("node"), F.sum("w").alias("w"), *_box(d))
    cells = cut_lineage(cells, "checkpoint")
    heavy = cells.where(F.col("w") >= min_samples)
    points = pts.join(cells.select(*keys, *cs, "node", (F.col("w") >= min_samples).alias("heavy")), keys + cs)
    points = cut_lineage(points, "persist")
    light = points.where(~F.col("heavy"))

    # 2. core points among the light ones
    told = cut_lineage(_core_of_light(heavy, light, keys, d, reach, eps, min_samples), "checkpoint")
    counted = told.where(F.col("node").isNull()).select(*keys, "pid", "n")
    if not told.where(F.col("node").isNotNull()).isEmpty():
        wanted = cells.select(*keys, *cs, "node").join(told.where(F.col("node").isNotNull()).select(*keys, "node").distinct(), keys + ["node"], "left_semi")
        held = points.where("heavy").join(wanted.select(*keys, *cs), keys + cs, "left_semi")
        opened = told.where(F.col("node").isNotNull()).join(light.select(*keys, "pid", *[F.col(x).alias(f"a{x}") for x in xs]), keys + ["pid"]) \
                     .join(held.select(*keys, "node", F.col("w").alias("bw"), *[F.col(x).alias(f"b{x}") for x in xs]), keys + ["node"]) \
                     .withColumn("bw", F.when(_dist2([f"a{x}" for x in xs], [f"b{x}" for x in xs]) <= F.lit(eps * eps), F.col("bw")).otherwise(0)) \
                     .groupBy(*keys, "pid").agg((F.sum("bw") + F.max("n")).alias("n"))
        counted = counted.unionByName(opened)
    light_core = counted.where(F.col("n") >= min_samples).select(*keys, "pid", F.lit(True).alias("core"))
    light = cut_lineage(light.join(light_core, keys + ["pid"], "left").withColumn("core", F.coalesce("core", F.lit(False))), "checkpoint")

    # 3. links of core cells by their boxes
    linked = {c: F.floor(F.col(x) / F.lit(link_side)).cast("long") for c, x in zip(cs, xs)}
    core = points.where("heavy").select(*keys, "pid", *xs).unionByName(light.where("core").select(*keys, "pid", *xs)).withColumns(linked)
    core_cells = cut_lineage(core.groupBy(*keys, *cs).agg(F.min("pid").alias("node"), *_box(d)), "checkpoint")
    links = cut_lineage(_linked_cells(core_cells, keys, d, link_reach, eps), "checkpoint")
    nodes = core_cells.select(*keys, "node")
    comp = cut_lineage(components_by_leaves(links.where("sure").select(*keys, "u", "v"), nodes, keys), "checkpoint")

    def core_in(wanted: DataFrame) -> DataFrame:
        """Core points (with their cell's node) of the wanted core cells only."""
        found = core_cells.select(*keys, *cs, "node").join(wanted.select(*keys, "node").distinct(), keys + ["node"], "left_semi")
        return core.join(cut_lineage(found, "persist"), keys + cs)

    # 4. open pairs across components, by descent
    if not links.where("not sure").isEmpty():
        of = {s: comp.select(*keys, F.col("node").alias(s), F.col("component").alias(f"_{s}")) for s in "uv"}
        apart = cut_lineage(links.where("not sure").select(*keys, "u", "v").distinct().join(of["u"], keys + ["u"]).join(of["v"], keys + ["v"])
                                 .where(F.col("_u") != F.col("_v")).select(*keys, F.col("u").alias("a"), F.col("v").alias("b")), "checkpoint")
        if not apart.isEmpty():
            ends = apart.select(*keys, F.col("a").alias("node")).unionByName(apart.select(*keys, F.col("b").alias("node")))
            joined = closest_within(apart, core_in(ends), keys, d, eps)
            stars = comp.select(*keys, F.col("node").alias("u"), F.col("component").alias("v")).where(F.col("u") != F.col("v"))
            comp = cut_lineage(components_by_leaves(stars.unionByName(joined.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))), nodes, keys), "checkpoint")

    # 5. cluster numbers by lowest row position per key
    cell_comp = core_cells.join(comp, keys + ["node"])
    first = cell_comp.groupBy(*keys, "component").agg(F.min("node").alias("first_pid"))
    ranked = with_row_index(first, keys + ["first_pid"], col="_g")
    if keys:
        ranked = ranked.join(ranked.groupBy(*keys).agg(F.min("_g").alias("_g0")), keys).withColumn("_g", F.col("_g") - F.col("_g0"))
    labelled = cut_lineage(cell_comp.join(ranked.select(*keys, "component", F.col("_g").cast("int").alias("cl")), keys + ["component"])
                                    .select(*keys, "node", *cs, *lo, *hi, "cl"), "checkpoint")

    # border points
    rest = light.where("not core").select(*keys, "pid", *xs, *[F.col(c).alias(f"_{c}") for c in cs]).withColumns(linked)
    told = cut_lineage(_border_labels(labelled, rest, keys, d, link_reach, eps), "checkpoint")
    border = told.where(F.col("node").isNull()).select(*keys, "pid", "cl")
    if not told.where(F.col("node").isNotNull()).isEmpty():
        held = core_in(told.where(F.col("node").isNotNull()))
        opened = told.where(F.col("node").isNotNull()).join(rest.select(*keys, "pid", *[F.col(x).alias(f"a{x}") for x in xs]), keys + ["pid"]) \
                     .join(held.select(*keys, "node", *[F.col(x).alias(f"b{x}") for x in xs]), keys + ["node"]) \
                     .where(_dist2([f"a{x}" for x in xs], [f"b{x}" for x in xs]) <= F.lit(eps * eps)).select(*keys, "pid", "cl")
        border = border.unionByName(opened)
    border = border.groupBy(*keys, "pid").agg(F.min("cl").cast("int").alias("cl"))

    # J1, back to the rows: the points of a heavy cell are one cluster, those of a light cell are listed (fewer than
    # min_samples); every input column is kept (no positional alignment)
    of_cell = labelled.select(*keys, *cs, "cl")
    whole = points.where("heavy and pid = node").select(*keys, *[F.col(c).alias(f"_{c}") for c in cs], *xs).withColumns(linked) \
                  .join(of_cell, keys + cs).select(*keys, *at, F.col("cl").alias("_cl"), F.lit(None).alias("_of"))
    single = light.where("core").select(*keys, *[F.col(c).alias(f"_{c}") for c in cs], *xs).withColumns(linked) \
                  .join(of_cell, keys + cs).select(*keys, *at, *xs, "cl") \
                  .unionByName(rest.join(border, keys + ["pid"]).select(*keys, *at, *xs, "cl"))
    listed = single.groupBy(*keys, *at).agg(F.collect_list(F.struct(*xs, "cl")).alias("_of")).select(*keys, *at, F.lit(None).cast("int").alias("_cl"), "_of")
    named = listed.unionByName(whole.withColumn("_of", F.col("_of").cast(listed.schema["_of"].dataType)))
    same = lambda p: reduce(Column.__and__, [p[x] == F.col(f) for x, f in zip(xs, features)])
    cluster = F.coalesce(F.col("_cl"), F.get(F.filter("_of", same), F.lit(0))["cl"], F.lit(-1))
    return rows.join(named, keys + at, "left").select(*[F.col(f"`{c}`") for c in df.columns if c not in (drop or [])], cluster.cast("int").alias(out_col))
