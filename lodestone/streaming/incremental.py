"""The incremental index as a stream: each batch of new file versions replaces the state of its files.

State is a folder with one table per batch; the newest is the index. A batch that runs again writes
its own number again, so a restart repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.corpus import changes, merged, tracked

SCHEMA = "file string, mtime bigint, content_hash string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, state: str) -> list[int]:
    fs, p = _fs(spark, state)
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]
    return sorted(int(x.getName().split("=")[1]) for x in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The state after the last batch (before a given one)."""
    found = [v for v in versions(spark, state) if before is None or v < before]
    return spark.read.schema(SCHEMA).parquet(f"{state}/batch={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def follow(files: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """files: a stream of (file, mtime, content). Runs over what is available and ends."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, state, number)
        newest = batch.groupBy("file").agg(F.max_by(F.struct("mtime", "content"), "mtime").alias("v")).select("file", "v.*")
        changed = changes(newest, old)
        rows = tracked(changed.filter("status = 'indexed'")).withColumn("status", F.lit("indexed"))
        merged(old, rows).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
