"""Five stages from raw documents to token ids.

Each stage is a function (spark, docs, sf_dir) whose result is written and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import Scratch, table
from lodestone.llm.stages import STAGES

#: Line templates, components and token ids are beyond SQL; the tests run the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = Scratch()
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        for done in kept.tables[:-1]:  # only the last one is read any more
            kept.drop(done)
    return STAGES[-1][1](spark, docs, sf_dir)
