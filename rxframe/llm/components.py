"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.session import materialize


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(``u``, ``v``) edges between two different comparable nodes each ->
    (``node``, ``root``): every node of an edge with the smallest node it reaches.

    Each round hangs nodes on the smallest neighbour known to their neighbours
    (large star), then on the smallest of their own (small star).  Minima are
    grouped with map-side combine and joined back, so a node with very many
    neighbours is a skewed join side that AQE splits, never one collected list.
    Rounds are written tables: lineage is cut and a lost executor costs one round.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), name)
    before = _checksum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u") \
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        after = _checksum(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
