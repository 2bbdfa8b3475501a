"""Connected components of links spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.storage import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of `links` (columns a, b): the smallest node that links reach.

    Links become stars round by round: first every node's larger neighbours are linked with the
    smallest one, then its smaller neighbours. Both steps keep the components. It ends when a
    round changes nothing, after a number of rounds that grows with the logarithm of the longest
    path. Each round is joins and aggregates on the node, so a node with very many links is
    split as any skewed join is. Null ends are left out, links of a node with itself change nothing.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        links = saved(_small_star(_large_star(links)), "links")
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node, linked with the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked with the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least).distinct()
