"""Connected components by alternating large-star and small-star steps over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each round rewrites the edges towards smaller nodes with aggregates that combine before the
    shuffle, so a hub with very many neighbours is not gathered.  The minima are checkpointed before
    they are joined back, which lets adaptive execution split a hub's rows on the other side.
    Rounds end when the edges no longer change; their number grows with the logarithm of the size.
    Null or equal ends are not edges; an empty input gives an empty result.
    """
    links = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = _signature(links)
    while True:
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = checkpoint(both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.min("hi")).alias("low")))
        # large star: a node's larger neighbours point at its smallest neighbour
        large = checkpoint(links.join(least, links.lo == least.node).select("hi", F.col("low").alias("lo")).distinct())
        least = checkpoint(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low")))
        # small star: a node and its smaller neighbours point at the smallest of them
        small = large.join(least, large.hi == least.node).select("hi", "lo", "low")
        small = small.select("hi", F.col("low").alias("lo")).unionByName(small.select(F.col("lo").alias("hi"), F.col("low").alias("lo")))
        links = checkpoint(small.where("hi <> lo").distinct())
        now = _signature(links)
        if now == before:
            break
        before = now
    return links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
