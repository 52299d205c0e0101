"""Facts about an application as relations: routes in groups, events, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence from worst to best.
CONFIDENCE = ("low", "medium", "high")


def grouped_routes(routes: DataFrame, groups: DataFrame, file: str = "file") -> DataFrame:
    """Routes (file, pos, path) with the prefixes of all groups (file, start, stop, prefix) around them, outermost first."""
    inside = routes.join(groups, file).filter("start < pos and pos < stop")
    around = inside.groupBy(file, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "prefix"))), lambda g: g["prefix"]), "").alias("_prefix"), F.count("*").alias("depth"))
    return routes.join(around, [file, "pos"], "left").select(file, "pos", F.concat(F.coalesce("_prefix", F.lit("")), "path").alias("path"), F.coalesce("depth", F.lit(0)).alias("depth"))


def paired_events(subscribers: DataFrame, emitters: DataFrame) -> DataFrame:
    """(event, place) on either side to one row per event with both sorted lists."""
    left = subscribers.groupBy("event").agg(F.array_sort(F.collect_set("place")).alias("subscribers"))
    right = emitters.groupBy("event").agg(F.array_sort(F.collect_set("place")).alias("emitters"))
    none = F.array().cast("array<string>")
    return left.join(right, "event", "full").select("event", F.coalesce("subscribers", none).alias("subscribers"), F.coalesce("emitters", none).alias("emitters"))


def worst_confidence(rows: DataFrame, by: str) -> DataFrame:
    """The worst confidence of each group."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    return rows.groupBy(by).agg(F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.min(rank).cast("int")).alias("confidence"))
