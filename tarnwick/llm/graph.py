"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import discard, materialize


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _centre(edges: DataFrame) -> DataFrame:
    """For each node that is an edge's ``a``: the least of itself and its partners."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map each node of ``edges`` (a, b) to the smallest node that it can reach: (node, root).

    Every round aggregates and joins on nodes, never gathering a component; hubs lose their
    edges to stars round by round. The rounds are O(log^2 n). Nodes without edges do not appear;
    self-loops and nulls are ignored. Raises if ``max_rounds`` do not suffice.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    last = _summary(edges)
    if not last[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_centre(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large")
        centre = _centre(large)
        partners = large.join(centre, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        before, edges = edges, partners.union(centre.select("a", F.col("low").alias("b"))).where("a <> b")
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = materialize(edges, "edges")
        discard(before)
        discard(large)
        now = _summary(edges)
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError("connected components did not settle")
