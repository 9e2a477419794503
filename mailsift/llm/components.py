"""Connected components of an edge table, as Spark joins and aggregations.

Alternating large-star and small-star steps: every node points its larger (or
smaller) neighbours at the smallest node it sees, until each component is a
star around its smallest node. The edge table is written to the shared folder
after each round, so no lineage grows and nothing reaches the driver except a
row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): links between longs, in any order, repeats allowed.
    Returns (node, root): every node of a link with the smallest node of its
    component. Null ends and self links are ignored."""
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .filter("a is not null and b is not null and a <> b").distinct())
    e = written(e, "edges")
    seen = _checksum(e)
    while seen[0]:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = (small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
               .union(least.select("a", F.col("m"))).distinct())
        new = written(new, "edges")
        now = _checksum(new)
        drop_written(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select("b", "b").distinct())
