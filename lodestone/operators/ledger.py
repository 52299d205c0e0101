"""The migration ledger: applied and pending, batches, and what a rollback would undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_name(files: DataFrame) -> DataFrame:
    """(file) to (file, id, name), cut at the first underscore."""
    pattern = "^([^_]+)_(.+)$"
    found = F.regexp_extract("file", pattern, 1)
    return files.select("file", F.when(found != "", found).otherwise(F.col("file")).alias("id"), F.when(found != "", F.regexp_extract("file", pattern, 2)).otherwise(F.col("file")).alias("name"))


def status(known: DataFrame, ledger: DataFrame) -> DataFrame:
    """(name) against (name, batch, executed_at): applied or pending, with the current batch (0 for an empty ledger)."""
    current = ledger.agg(F.coalesce(F.max("batch"), F.lit(0)).alias("current_batch"))
    rows = known.join(ledger, "name", "left").join(F.broadcast(current))  # one row
    return rows.select("name", F.when(F.col("batch").isNotNull(), "applied").otherwise("pending").alias("state"), "batch", "executed_at", "current_batch")


def rollback(ledger: DataFrame, steps: int, preview: bool = True) -> DataFrame:
    """Migrations of the last batches. A preview counts batch numbers down from the highest; a run takes the batches that exist."""
    if preview:
        top = ledger.agg(F.coalesce(F.max("batch"), F.lit(0)).alias("top"))
        return ledger.join(F.broadcast(top)).filter((F.col("batch") <= F.col("top")) & (F.col("batch") > F.greatest(F.lit(0), F.col("top") - steps))).drop("top")
    last = ledger.select("batch").distinct().orderBy(F.desc("batch")).limit(steps)
    return ledger.join(F.broadcast(last), "batch", "left_semi")


def mean_duration(total_ms: int, executed: int) -> int:
    return round(total_ms / executed) if executed else 0
