"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import stored


def _state(links: DataFrame) -> tuple:
    """Number of links and a sum over them; equal in two rounds when nothing has changed."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionAll(
        links.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.join(least, "node").where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return least.select("high", F.col("least").alias("low")).unionAll(moved).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    ``links`` has columns ``a, b`` of one orderable type; self-links and nulls are passed over, repeats do not matter, an
    empty table gives no rows. Rounds grow with the logarithm of the nodes; each combines before its shuffles,
    keeps no neighbourhood in one task, and is written to the shared folder.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    held = stored(ordered, "links")
    before, now = None, _state(held)
    while now[0] and now != before:
        held = stored(_small_star(_large_star(held)), "stars")
        before, now = now, _state(held)
    nodes = held.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return nodes.unionAll(held.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
