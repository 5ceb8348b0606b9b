"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lows = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lows = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lows.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, roots being the smallest node reachable.

    Each round halves path lengths at least, so the number of rounds is logarithmic in the longest path.
    A node with very many edges is aggregated in the map-side combine and met again only as the one-row side
    of a join, so it is never one task's work. Edges that touch NULL and loops are ignored. No edges: no rows.
    """
    links = stored(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "links")
    shape = None
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == shape:
            break
        shape = tuple(now)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
