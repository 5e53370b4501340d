"""Connected components over edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import materialize


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b); isolated nodes do not occur.

    Alternates large-star and small-star steps (each node links its neighbours to the least of them), written out each
    round, until every node points straight at its component's least; that takes about the logarithm of the longest path.
    Groups meet by partial minima, never as lists. Raises RuntimeError if `rounds` do not suffice.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = materialize(small.distinct(), "edges")
        before, seen = seen, after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if seen == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select("b", "b").distinct())
        edges = after
    raise RuntimeError("components did not settle")
