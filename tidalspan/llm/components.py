"""Connected components by alternating large-star and small-star rounds.

Each round replaces the edges by ones that point to smaller nodes, until every edge is (node,
smallest node of its component). Every table is aggregated by node before it is joined, and is
written to the shared folder between rounds; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm import storage


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has a smaller one in its component, and the smallest. edges: (u, v)
    longs, in any direction; nodes without edges do not occur."""
    now = storage.stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _checksum(now)
    while state[0]:
        large = storage.stored(_large_star(now), "large-star")
        following = storage.stored(_small_star(large), "small-star")
        storage.drop(now)
        storage.drop(large)
        before, now = state, following
        state = _checksum(now)
        if state == before:
            break
    return now
