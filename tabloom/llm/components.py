"""Connected components of a table of edges, by alternating stars.

Each round hangs every node's larger neighbours on its smallest neighbour, then
every node's smaller neighbours likewise. The edges stay as many as they were or
fewer, become a star per component after a number of rounds that grows with the
logarithm of the nodes, and never come to the driver. Every round is written to
the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.runtime import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of an edge between different nodes."""
    table = materialize(
        edges.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).where("a <> b").distinct(), "edges"
    )
    last = _state(table)
    while last[0]:
        table = materialize(_small_star(_large_star(table)), "stars")
        now = _state(table)
        if now == last:
            break
        last = now
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
