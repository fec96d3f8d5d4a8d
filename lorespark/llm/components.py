"""Connected components by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)`` (numbers).

    The component is its smallest node, which has no row of its own. Each
    round links the neighbours of a node to its smallest neighbour, first
    those above it, then those below. Rounds grow with the logarithm of the
    longest path, and every round is written to the shared folder. A node
    with very many links is met by pre-aggregated minima and by joins that
    adaptive execution can split. Runs jobs.
    """
    u, v = F.col("u"), F.col("v")
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stage(links, "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            return links.select(u.alias("node"), v.alias("component"))
        before = tuple(state)
        both = links.unionAll(links.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        # a node's own smallest neighbour keeps its link
        large = large.unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(v.alias("u"), F.col("m").alias("v"))
        links = stage(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
