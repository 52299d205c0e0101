"""Contiguous shards of equal bytes from global prefix sums.

Rows stand in the order of (range, part, digest, id): the range is the first byte of the text's md5
digest, the part one byte of the id's. Totals of bytes and rows are summed per (range, part); prefix
sums over the ranges, over the parts of each range and over the rows of each part add up to the place
of a row in the whole table, and its shard is that place over an equal target. Ranges and parts are
RANGES and PARTS at most whatever the input, so the sums across them are small; the rows move twice,
as (id, size, checksum, digest), texts never.

Equal texts share a range, a run of 1 / RANGES of the bytes or so, and its parts spread a group of
equal texts of any size over tasks. They share a shard unless a border cuts their range: at most one
range per border, or more where a group is itself larger than what is left of a shard. Rows that repeat
id and text are one row with a count while they move; their order among each other has no meaning.

A null text counts no bytes and stands as the empty text; sizes are bytes plus one, so no total is 0.
A null id counts as an empty string for its part. A text of any length is only measured and hashed.
An empty table gives an empty result. Only the id and the text are read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import dropped, table, written

SHARDS, RANGES, PARTS = 16, 256, 256
BEFORE = (Window.unboundedPreceding, -1)


def placed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, size, text_crc32, before, row_no) of each row, and the totals (bytes, rows) as one row."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    byte = lambda digest: F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    keyed = df.select(df[id_col].alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("digest"))
    once = keyed.groupBy("id", "size", "text_crc32", "digest").agg(F.count("*").alias("n"))
    rows = written(once.withColumn("range", byte(F.col("digest"))).withColumn("part", byte(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))))
    parts = rows.groupBy("range", "part").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n"))
    # At most RANGES * PARTS rows.
    parts = written(parts)
    ranges = parts.groupBy("range").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    over = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*BEFORE)), F.lit(0))
    by_range, by_part = Window.orderBy("range"), Window.partitionBy("range").orderBy("part")
    range_at = ranges.select(F.col("range").alias("r"), over("b", by_range).alias("range_b"), over("n", by_range).alias("range_n"))
    starts = parts.join(F.broadcast(range_at), F.col("range") == F.col("r")).select("range", "part", (over("b", by_part) + F.col("range_b")).alias("from_b"), (over("n", by_part) + F.col("range_n")).alias("from_n"))
    inside = Window.partitionBy("range", "part").orderBy("digest", "id")
    summed = rows.withColumn("own_b", over(F.col("size") * F.col("n"), inside)).withColumn("own_n", over("n", inside))
    at = summed.join(F.broadcast(starts.withColumnRenamed("range", "r").withColumnRenamed("part", "p")), (F.col("range") == F.col("r")) & (F.col("part") == F.col("p")))
    each = at.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    out = each.select("id", "size", "text_crc32", (F.col("from_b") + F.col("own_b") + F.col("k") * F.col("size")).alias("before"), (F.col("from_n") + F.col("own_n") + F.col("k")).alias("row_no"))
    return out, parts.agg(F.sum("b").alias("total"))


def shard_by_bytes(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id_col, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... in its shard)."""
    rows, total = placed(df, id_col, text_col)
    # One row.
    shard = F.least(F.floor(F.col("before") * shards / F.col("total")), F.lit(shards - 1)).cast("int")
    cut = written(rows.join(F.broadcast(total)).withColumn("shard", shard).drop("before", "total"))
    # One row per shard.
    firsts = cut.groupBy("shard").agg(F.min("row_no").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row_no") - F.col("first")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum of a text, byte by byte from a table of 256 entries, is built by the same rule as everywhere: reflected, polynomial EDB88320.
SQL = r"""
WITH RECURSIVE step(v, c, k) AS (
  SELECT v, v::BIGINT, 0 FROM range(256) AS t(v) UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size, text, md5(text) AS digest, md5(coalesce(doc_id::VARCHAR, '')) AS own FROM d),
s AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total, row_number() OVER w - 1 AS row_no
  FROM h WINDOW w AS (ORDER BY digest[1:2], own[1:2], digest, doc_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, least(floor(before::DOUBLE * 16 / total::DOUBLE), 15)::INT AS shard FROM s)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(crc.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_no - min(row_no) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM c, crc
"""
