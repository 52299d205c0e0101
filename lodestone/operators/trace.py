"""Requirement marks in source lines, the index of their places, and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The mark, the shapes of ids, the budgets of a scan.
MARK = "@implements"
IDS = r"^(FR[0-9]+|MISS-[0-9]+|Story [0-9]+(\.[0-9]+){1,2}|Epic [0-9]+)$"
MAX_FILES, MAX_TOTAL = 20_000, 64 * 1024 * 1024


def marked_ids(line: Column) -> Column:
    """Ids after the first mark of a line; parts that are no id are dropped."""
    at = F.instr(line, MARK)
    rest = F.regexp_replace(F.substring(line, at + len(MARK), F.length(line)), r"\*/.*$", "")
    parts = F.transform(F.split(rest, ","), lambda x: F.trim(F.substring_index(x, "(", 1)))
    return F.when(at > 0, F.filter(parts, lambda x: x.rlike(IDS))).otherwise(F.array().cast("array<string>"))


def is_test(file: Column) -> Column:
    return file.contains("/tests/") | file.contains(".test.") | file.contains(".spec.")


def sites(lines: DataFrame) -> DataFrame:
    """(file, line, text) to (requirement, file, line, is_test)."""
    return lines.filter(F.col("text").contains(MARK)).select(F.explode(marked_ids(F.col("text"))).alias("requirement"), "file", "line", is_test(F.col("file")).alias("is_test"))


def index(lines: DataFrame) -> DataFrame:
    """Per requirement the number of places in code and in tests."""
    return sites(lines).groupBy("requirement").agg(F.count_if(~F.col("is_test")).alias("implementations"), F.count_if("is_test").alias("tests"), F.min(F.struct("file", "line")).alias("first"))


def gaps(found: DataFrame) -> DataFrame:
    """Requirements without an implementation, tests or not."""
    return found.filter("implementations = 0")


def within_budget(files: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL, by: str = "file", size: str = "size") -> DataFrame:
    """Files in order up to the first that breaks a budget.

    Running sums per range of the order, then over the ranges' totals: no task gets all files.
    """
    spark = files.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = files.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(by)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_n", F.row_number().over(own)).withColumn("_b", F.sum(size).over(upto))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_part").agg(F.max("_n").alias("n"), F.max("_b").alias("b")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"))
    # One row per partition.
    return local.join(F.broadcast(totals), "_part").filter((F.col("_n") + F.col("_n0") <= max_files) & (F.col("_b") + F.col("_b0") <= max_total)).select(*files.columns)
