"""Connected components of an undirected graph held as an edge DataFrame.

Alternating *large-star* / *small-star* rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014): each round is one
aggregation and one join over the edge list, the number of rounds grows
with log² of the component size, and no step gathers a component in one
task. Lineage is cut with ``checkpoint()`` every few rounds.

Edges carry optional partition ``keys`` (e.g. a batch number); nodes are
only compared within equal keys. Node ids are longs.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.session import cut_lineage


def _sym(e: DataFrame, keys: list[str]) -> DataFrame:
    return e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    s = _sym(e, keys)
    m = s.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = (s.join(m, keys + ["u"]).where(F.col("v") > F.col("u"))
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    # orient every edge from the larger to the smaller id
    o = e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) \
         .where(F.col("u") != F.col("v")).distinct()
    m = o.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    j = o.join(m, keys + ["u"])
    moved = j.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    star = m.select(*keys, "u", F.col("m").alias("v"))
    return moved.unionByName(star).where(F.col("u") != F.col("v")).distinct()


def _stars(e: DataFrame, keys: list[str]) -> bool:
    """Whether no node has two edges to lower ones, or one while others lead to it."""
    e = e.distinct()
    ends = e.select(*keys, F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(*keys, F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy(*keys, "n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None,
                         keys: list[str] | None = None, checkpoint_every: int = 2) -> DataFrame:
    """Return ``keys…, node, component`` with component = smallest node id of the component.

    ``edges`` has columns ``keys…, u, v``; ``nodes`` (``keys…, node``) adds
    isolated nodes.
    """
    keys = list(keys or [])
    e = edges.select(*keys, F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")) \
             .where(F.col("u") != F.col("v"))
    e = cut_lineage(e, "persist")  # as dealt: a shuffle here would leave its many small partitions in the cache
    for i in count():  # until every edge leads from a node to its star's least one
        if _stars(e, keys):
            break
        e = _small_star(_large_star(e, keys), keys)
        e = cut_lineage(e, "checkpoint" if (i + 1) % checkpoint_every == 0 else "persist")
    # converged: every edge points from a node to its component minimum
    labels = e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    roots = labels.select(*keys, F.col("component").alias("node"), "component").distinct()
    out = labels.unionByName(roots)
    if nodes is not None:
        alone = (nodes.select(*keys, F.col("node").cast("long"))
                      .join(out.select(*keys, "node"), keys + ["node"], "left_anti")
                      .withColumn("component", F.col("node")))
        out = out.unionByName(alone)
    return out


def components_by_leaves(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``connected_components`` of graphs whose nodes mostly lead to a lower one and have none leading to them.

    Such leaves take the component of their lowest neighbour: the rounds run over the other nodes alone, with
    every leaf's neighbours joined to its lowest.
    """
    keys = list(keys or [])
    e = edges.select(*keys, F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")) \
             .where(F.col("u") != F.col("v"))
    # checkpoints, not persisted frames: those keep their whole plan, which every later job would go through again
    e = cut_lineage(e, "checkpoint")
    least = cut_lineage(e.groupBy(*keys, "u").agg(F.min("v").alias("m")), "checkpoint")
    inner = cut_lineage(e.select(*keys, F.col("v").alias("u")).distinct(), "checkpoint")
    moved = e.join(least, keys + ["u"]).where(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    between = moved.unionByName(least.join(inner, keys + ["u"], "left_semi").select(*keys, "u", F.col("m").alias("v"))).distinct()
    comp = cut_lineage(connected_components(cut_lineage(between, "checkpoint"), inner.select(*keys, F.col("u").alias("node")), keys), "checkpoint")
    leaves = least.join(inner, keys + ["u"], "left_anti").join(comp.withColumnRenamed("node", "m"), keys + ["m"])
    out = comp.unionByName(leaves.select(*keys, F.col("u").alias("node"), "component"))
    alone = (nodes.select(*keys, F.col("node").cast("long")).join(least.select(*keys, F.col("u").alias("node")), keys + ["node"], "left_anti")
                  .join(inner.select(*keys, F.col("u").alias("node")), keys + ["node"], "left_anti").withColumn("component", F.col("node")))
    return out.unionByName(alone)
