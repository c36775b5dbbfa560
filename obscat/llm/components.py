"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, passing, stored

#: Below so many links a node's own links fit into any task, and a round is one job.
FEW = 1_000_000


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum((mark % 1000003).cast("long")), F.sum((mark % 998244353).cast("long"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of links(a, b).

    Each round replaces a node's greater neighbours' links by links to the least
    neighbour, then the same for its lesser ones, until nothing changes: a number
    of rounds that grows with the logarithm of the largest component.  Both steps
    aggregate before they exchange.  With many links each step's result is
    written, so that a hub's links come from a plain exchange whose large
    partitions Spark can split.  Nulls are not nodes; an empty table gives an
    empty result.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropna().filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        kept = stored if state[0] > FEW else lambda df: df
        with passing(links.sparkSession) as keep:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = kept(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
            large = kept(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            after = keep(stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct()))
        let_go(edges)
        edges = after
        state, before = _state(edges), state
        if state == before:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after some more links: components of labels, not of nodes, are sought anew."""
    named = links
    for end in "ab":
        names = labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        named = named.join(names, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    above = stored(components(named.select("a", "b").distinct())).select(F.col("node").alias("label"), F.col("label").alias("top"))
    nodes = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return nodes.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
