"""Connected components by alternating large and small stars.

Every round links each node's neighbours to the smallest node it knows, so paths shorten to stars in
a logarithmic number of rounds. Rounds are written to the shared folder; only one row with a count and
a sum of hashes comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, written


def _linked(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (u, v): v is linked to the least of u and its neighbours; for larger v alone, or all of them."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    out = pairs.join(least, "u")
    if larger:
        return out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).filter("a <> b")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) of numbers: (node, component), the smallest node reachable, for each node that has a link to another one."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(_linked(both, True).distinct())
        small = written(_linked(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct())
        after = _signature(small)
        dropped(now), dropped(large)
        now = small
        if after == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        before = after
