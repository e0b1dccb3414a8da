"""Connected components of a large sparse graph, by large-star and small-star.

Every step is a grouping that combines before the shuffle and an equality join
between stored tables, so a star with very many leaves is split by adaptive
execution. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours to its smallest neighbour.

    ``large`` links the larger neighbours, else the smaller ones and the node.
    ``edges`` holds (a, b) with a > b.
    """
    if large:
        both = edges.select("a", "b").unionByName(
            edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    least = stored(least)
    joined = both.join(least, both["a"] == least["node"])
    if large:
        linked = joined.filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.filter(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return stored(linked.filter("a != b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node.

    Nodes of any orderable type. Loops, repeated and reversed edges are fine;
    null ends are dropped. No edges give no rows.
    """
    links = stored(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct())
    before = None
    while True:
        links = _star(_star(links, large=True), large=False)
        # A finished graph is a set of stars: no centre is a leaf of another.
        shape = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if shape == before or shape[0] == 0:
            break
        before = shape
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(leaves.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
