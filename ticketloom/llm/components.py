"""Connected components by alternating large and small stars, each round a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.staging import staged


def _finished(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each a has one edge and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not nodes.agg(F.count_if(F.col("out") > 1 - F.col("in"))).first()[0]


def _stars(edges: DataFrame, near: DataFrame, keep) -> DataFrame:
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = near.join(least, "a").filter(keep).select(
        F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    own = least.filter(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id each linked node reaches. Loops and repeats are ignored.

    Node ids are longs. The edges are read several times: pass a written table. The edge set shrinks to
    stars around the smallest ids in a number of rounds that grows with the logarithm of the longest chain;
    every round is written to the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b"))
    while not _finished(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(now, both, F.col("b") > F.col("a"))
        now = staged(_stars(large, large, F.lit(True)), "stars")
    roots = now.select(F.col("b").alias("node")).distinct().select(
        "node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
