"""Stages of a corpus pipeline: functions (spark, docs, sf_dir) that return the columns of docs, but for the last.

Null texts and texts without words are rejected by the first stage; given to a later one they pass it as
its operator says: no lines to drop, no copies, size 0 (so never taken twice and taken as their source's
rate says), no tokens. Texts of any length are taken whole. Rows that repeat an id and a text are judged alike by
the first two stages, one of them passes the third, and both are emitted alike by the fourth. Ties: copies keep the
row with the smallest id, then the least text. An empty table passes every stage as an empty table. Columns besides
those of documents are carried through the first four stages, whatever their names; n_chars is set anew where a text
changes, if there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, lines, mixing, neardup, quality

#: Bytes of texts encoded at a time: less than alone, as executors of a pipeline have done four stages before.
GROUP_BYTES = 3_000_000


def recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars from the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without their failing lines."""
    return recounted(quality.filter_documents(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates."""
    return recounted(lines.line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicated(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.emitted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, bpe.tokenizer_path(), fields=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), group_bytes=GROUP_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("encoding", encoding),
]
