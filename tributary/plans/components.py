"""Connected components of an edge table by alternating stars.

Each round links the larger neighbours of a node to the smallest one it knows
(large star), then its smaller neighbours likewise (small star); the rounds
needed grow with the logarithm of a component's size.  Rows travel as joins
and partial minima, never as lists, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars", rounds: int = 60) -> DataFrame:
    """``edges`` (a, b), any order, to (node, root): every node that has an edge but the roots, root the smallest of its component."""
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    current = own
    for k in range(rounds):
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        current = scratch.save(small, f"{name}{k}")
        if k > 0:
            scratch.drop(f"{name}{k - 1}")
        # settled: every node but the roots has one edge, to a node that has none upwards
        nodes = current.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if current.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and nodes.filter("n > 1").isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
