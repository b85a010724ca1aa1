"""Connected components of a graph given as links, by alternating large-star and small-star rounds.

Each round is a few joins and aggregates over the links that are left; its links are written to the shared folder, so lost
executors repeat tasks, not rounds. Links shrink towards one star for each component, in about log(size) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilume.session import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link to another one.

    Links may be repeated and given in either direction; NULL ends and links of a node to itself count for nothing.
    Nodes can be of any ordered type.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u != v").distinct(),
        "links",
    )
    while True:
        # large star: of each node, the larger neighbours go to the least one
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
            .where("u != v").distinct()
        )
        after = stored(after, "links")
        # a star has no node that is both an end and a centre
        if after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and _single(after):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        edges = after


def _single(edges: DataFrame) -> bool:
    """Whether every node has one centre."""
    return edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
