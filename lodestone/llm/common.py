"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words, in a character class.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder inside the one that the cluster shares (spark.checkpoint.dir).

    Where the session names none on a single machine, as in tests, a temporary folder is set; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get()
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lodestone_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """Tables written on the way to a result: called like `written`; `clear` deletes them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(written(df))
        return self.tables[-1]

    def drop(self, df: DataFrame) -> None:
        dropped(df)
        self.tables = [t for t in self.tables if t is not df]

    def clear(self) -> None:
        for t in list(self.tables):
            self.drop(t)


#: Words of 64 bits in a bitmap: 2 ** 17 rows, 8 million bits, however much it stands for.
BITMAP = 1 << 17


def _slot(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP * 64))
    return F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))


def bitmap(keys: DataFrame, key: str, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """The keys as a written bitmap of at most BITMAP rows."""
    word, bit = _slot(F.col(key))
    return write(keys.select(word.alias("bitmap_word"), bit.alias("bitmap_bit")).groupBy("bitmap_word").agg(F.bit_or("bitmap_bit").alias("bitmap_bits")))


def perhaps_in(df: DataFrame, bits: DataFrame, key: Column, flag: str) -> DataFrame:
    """df with a flag that is false only for keys that are not in the bitmap; nothing is shuffled."""
    word, bit = _slot(key)
    # At most BITMAP rows.
    joined = df.join(F.broadcast(bits), word == bits["bitmap_word"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(bits["bitmap_bits"].bitwiseAND(bit) != 0, F.lit(False)).alias(flag))


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def count_words(text: Column, separators: str = SPACE) -> Column:
    """Maximal runs of characters outside `separators`; null has none.

    A split keeps one empty string before a leading and after a trailing separator, no others.
    """
    parts = F.split(F.coalesce(text, F.lit("")), f"[{separators}]+")
    edge = lambda x: F.when(x == "", 1).otherwise(0)
    n = F.size(parts)
    return F.when(n == 1, 1 - edge(parts[0])).otherwise(n - edge(parts[0]) - edge(F.element_at(parts, -1))).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


BATCH, ROWS_PER_BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What workers remember between tasks, by operator, and how to forget it.
FORGET: dict[str, Callable[[], object]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow, for workers that live for many tasks and operators.

    It begins by forgetting what operators other than `keeps` remember, and ends by giving Arrow's free memory back.
    Where the session has Spark's default of 10,000 rows a batch, it gets BATCH: so many whole texts at a time would hold
    tens of MB in the executor and in its worker.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(ROWS_PER_BATCH) == "10000":
        spark.conf.set(ROWS_PER_BATCH, BATCH)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in FORGET.items():
            if name != keeps:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by numeric `keys`, one table each; holds one group and one batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        cut = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            cut |= np.diff(rows.column(k).to_numpy()) != 0
        edges = [0, *(np.flatnonzero(cut) + 1)]
        for lo, hi in zip(edges, edges[1:]):
            yield rows.slice(lo, hi - lo)
        held = rows.slice(edges[-1])
    if held is not None:
        yield held


def running(keyed: DataFrame, by: list[str], size: str) -> DataFrame:
    """Sort globally, number the rows and add up sizes: columns row_no and before (sizes of all earlier rows).

    The partitions with their own sums are written to the shared folder; their totals are the only
    thing summed across partitions.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at, names = keyed.columns.index(size), [*keyed.columns, "part", "own_no", "own_before"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", part int, own_no bigint, own_before bigint"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(total + sums - sizes)],
                names=names,
            )
            rows, total = rows + n, total + int(sums[-1]) if n else total

    summed = written(ranged.mapInArrow(tidy(add), schema))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        summed.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
        .select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(order), F.lit(0)).alias("size_before"))
    )
    # One row per partition of the sort: at most `parts` rows.
    out = summed.join(F.broadcast(offsets), "part")
    return out.withColumn("row_no", F.col("own_no") + F.col("rows_before")).withColumn("before", F.col("own_before") + F.col("size_before")).drop("part", "own_no", "own_before", "rows_before", "size_before")
