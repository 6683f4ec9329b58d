"""Connected components by alternating large-star and small-star.

Large-star links every neighbour greater than a node to the node's least neighbour, small-star links a node
and its lesser neighbours to the least of them; both keep the components and end in stars around the
least node of each.  Minima are partial aggregates, and the join that hands them out has one row a node on
one side, so a node with a large share of all links is split over tasks.  Every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import written


def _star(links: DataFrame) -> DataFrame:
    """(node, other) links to (node, other, least), least being the least of node and its others."""
    least = links.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    return links.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
    return (
        _star(both).filter((F.col("other") > F.col("node")) & (F.col("other") != F.col("least")))
        .select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    stars = _star(edges.select(F.col("high").alias("node"), F.col("low").alias("other")))
    to_least = stars.select(F.explode(F.array("node", "other")).alias("high"), F.col("least").alias("low"))
    return to_least.filter(F.col("high") != F.col("low")).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _trace(edges: DataFrame):
    """Equal sets of edges have equal counts and sums of hashes."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) after one round: the same components in fewer steps, stars already where one was drawn."""
    return written(_small_star(_large_star(_oriented(edges))), "edges").select(F.col("high").alias("a"), F.col("low").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the ``edges`` (a, b); root is the least node of its component."""
    edges = written(_oriented(edges), "edges")
    seen = _trace(edges)
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _trace(edges)
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return leaves.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
