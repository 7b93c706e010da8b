"""Connected components by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.stage import dropped, written

MAX_ROUNDS = 50


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # written: with an exchange of its own on each side Spark can split the edges of a hub over many tasks
    least = written(least, "least")
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return (
        down.join(least, "a")
        .filter(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
    )


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): every node that has an edge, with the least node of its component.

    Work per round is in proportion to the edges; a hub's edges are joined, never gathered in one row.
    The driver gets a count and a checksum per round. Edges of a node to itself and repeated edges count for nothing, so
    a node with no other edge is in no row; edges with a null end are left out; no edges give no rows.
    """
    clean = lambda df: df.filter(F.col("a") != F.col("b")).distinct()
    mark = lambda df: tuple(
        df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    )
    edges = written(clean(edges), "edges")
    seen = mark(edges)
    for _ in range(MAX_ROUNDS):
        large = written(clean(_large_star(edges)), "edges")
        dropped(edges)
        edges = written(clean(_small_star(large)), "edges")
        dropped(large)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
