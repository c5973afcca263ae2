"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours now hang on its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable.

    Alternates the two star operations until the edge set stays the same; each
    round is one small shuffle job whose result is checkpointed, so a lost
    executor costs at most a round.  The number of rounds grows with the
    logarithm of the graph, and only a count and a checksum reach the driver.
    Loops, repeated and null-ended edges are ignored; no edges, no rows.
    """
    x, y = F.col(a), F.col(b)
    current = checkpointed(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = _state(current)
    while state[0]:
        current = checkpointed(_smaller_to_smallest(_to_smallest(current)))
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
