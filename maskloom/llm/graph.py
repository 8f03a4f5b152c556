"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., 2014), all in DataFrames, lineage cut after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.runtime import cut


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has long columns a and b; the result (node, component) names every
    node of an edge with the smallest node that it reaches. No edge, no rows.
    Classes not stable after ``max_rounds`` are an error, never a result."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.where(F.col("a") != F.col("b")).distinct())
    mark = _mark(edges)
    stable, rounds = not mark[0], 0
    while not stable:
        if rounds == max_rounds:
            raise RuntimeError(f"components are not stable after {max_rounds} rounds")
        rounds += 1
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(
            F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
        edges = cut(small.where(F.col("a") != F.col("b")).distinct())
        before, mark = mark, _mark(edges)
        stable = mark == before
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct())
