"""Mixing sources to target weights.

Tokens are summed per source and each source gets a target from its weight; the repetition rate is
the target over the source's size. A document is emitted floor(rate) times, plus once more if a
hash of the seed and its id, taken as a number in [0, 1), lies below the rate's fraction. No state
is kept, so reruns agree and repeated rows are treated alike.

Targets: sources ordered by code point, null last (null is a source), weigh 1, 2, 3, 1, 2, 3, ... and
share all tokens; a target stops at `most` times its source's size and the excess goes to the others
by weight. That is min(cap, level * weight) for one level, found with running sums over the sources
in the order of cap / weight. Only that table, one row per source, is ordered in one task.

Null texts have size 0; where all sizes are 0 nothing is taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import count_words, free, table, written

MOST, SEED = 3, "mix-1"


def drawn(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    bits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(bits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """From (source, source_size) with one row per source: adds target and rate."""
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    order = Window.orderBy("full_at", F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sources.withColumn("weight", ((F.row_number().over(every) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("room", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", F.col("room") / F.col("weights"))
        # Sources before the first whose cap lies above the level of what is left are full; from there on levels only fall.
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))).over(whole))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
    )
    return ranked.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per input row: id_col, source, size, source_size, target, rate and copies (0 to `most`)."""
    sized = written(df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("source"), count_words(df[text_col]).alias("size")))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    rows = sized.alias("d").join(by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    whole = F.floor("s.rate")
    extra = (drawn(seed, F.col("d.id")) < F.col("s.rate") - whole).cast("int")
    return rows.select(F.col("d.id").alias(id_col), F.col("d.source").alias("source"), "size", "source_size", "target", "rate", (whole.cast("int") + extra).alias("copies"))


def emitted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of the input.

    The rate depends on the source alone, so the texts are joined with one row per source.
    """
    sized = df.select(df[source_col].cast("string").alias("source"), count_words(df[text_col]).alias("size"))
    name, rate, copy = free(df, "source_of_rate"), free(df, "rate"), free(df, "copy")
    # Written, so that its size is known before the texts move: a small table of sources then costs them no shuffle.
    rates = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most).select(F.col("source").alias(name), F.col("rate").alias(rate)))
    joined = df.join(rates, df[source_col].cast("string").eqNullSafe(F.col(name)))
    copies = F.floor(rate).cast("int") + (drawn(seed, df[id_col]) < F.col(rate) - F.floor(rate)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS full_at FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM s2),
s4 AS (SELECT *, max(CASE WHEN room / weights <= full_at THEN room / weights END) OVER () AS level FROM s3),
s5 AS (SELECT *, coalesce(least(cap, level * weight), cap) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate FROM s5)
SELECT d.doc_id, d.size, s.source_size, s.target,
  (d.size * (floor(s.rate)::INT + (('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0 < s.rate - floor(s.rate))::INT))::BIGINT AS taken
FROM d JOIN s6 AS s ON d.source IS NOT DISTINCT FROM s.source
"""
