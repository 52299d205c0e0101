"""Inputs of the registered queries, derived from the test tables by the same expressions as in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: id, package, kind, heading, body."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id", "source as package", "case lang when 'en' then 'Markdown' when 'de' then 'Readme' when 'fr' then 'Adr' else 'Bmad' end as kind", "concat('Corpus ', lang) as heading", "text as body"
    )


CHUNKS = "chunks AS (SELECT doc_id AS id, source AS package, CASE lang WHEN 'en' THEN 'Markdown' WHEN 'de' THEN 'Readme' WHEN 'fr' THEN 'Adr' ELSE 'Bmad' END AS kind, 'Corpus ' || lang AS heading, text AS body FROM documents)"

_PATH = """case doc_id % 9 when 0 then 'README.md' when 1 then {docs} when 2 then {pkg_readme} when 3 then {pkg_fix} when 4 then {adr} when 5 then {plan}
 when 6 then {deep} when 7 then {code} else {other} end"""
_PARTS = {
    "docs": ("'docs/'", "lang", "'/'", "doc_id", "'.md'"), "pkg_readme": ("'packages/'", "source", "'/README.md'"), "pkg_fix": ("'packages/'", "source", "'/CORRECTIONS.md'"),
    "adr": ("'_bmad-output/planning-artifacts/adr-'", "doc_id", "'.md'"), "plan": ("'_bmad-output/planning-artifacts/'", "lang", "'/epics-'", "doc_id", "'.md'"),
    "deep": ("'packages/'", "source", "'/docs/README.md'"), "code": ("'docs/'", "doc_id", "'.txt'"), "other": ("'notes/'", "source", "'/'", "doc_id", "'.md'"),
}
PATH_SPARK = _PATH.format(**{k: f"concat({', '.join(v)})" for k, v in _PARTS.items()})
PATH_SQL = _PATH.format(**{k: " || ".join(v) for k, v in _PARTS.items()})


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, doc_id, mtime, content); files 0, 2, 3 and 6 of each nine share paths, so the id keeps them apart."""
    return table(spark, sf_dir, "documents").selectExpr(f"{PATH_SPARK} as file", "doc_id", "1700000000000 + doc_id * 1000 as mtime", "text as content")


FILES = f"files AS (SELECT {PATH_SQL} AS file, doc_id, 1700000000000 + doc_id * 1000 AS mtime, text AS content FROM documents)"


def old_snapshot(files: DataFrame) -> DataFrame:
    """The state of an earlier run: some files missing, some older, some gone since."""
    return files.filter("doc_id % 5 <> 0").selectExpr("concat('f', doc_id) as file", "case when doc_id % 4 = 0 then mtime - 500 else mtime end as mtime", "doc_id")


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines with requirement marks, from events."""
    return table(spark, sf_dir, "events").selectExpr(
        "case when user_id % 4 = 0 then concat('packages/', event_type, '/tests/f', event_id % 97, '.test.ts') else concat('packages/', event_type, '/src/f', event_id % 97, '.ts') end as file",
        "cast(event_id as int) as line",
        """case event_id % 6 when 0 then concat('// @implements FR', user_id) when 1 then concat(' * @implements FR', user_id, ', MISS-', user_id % 7, ' (both)')
           when 2 then concat('/* @implements Story ', user_id % 9, '.', event_id % 5, ' */') when 3 then concat('// @implements FR', user_id, ' see notes') when 4 then concat('# @implements Epic ', user_id % 11, ',FRx') else 'const x = 1;' end as text""",
    )


TRACE_LINES = """trace_lines AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'packages/' || event_type || '/tests/f' || (event_id % 97) || '.test.ts' ELSE 'packages/' || event_type || '/src/f' || (event_id % 97) || '.ts' END AS file,
  event_id::INT AS line, CASE event_id % 6 WHEN 0 THEN '// @implements FR' || user_id WHEN 1 THEN ' * @implements FR' || user_id || ', MISS-' || (user_id % 7) || ' (both)'
  WHEN 2 THEN '/* @implements Story ' || (user_id % 9) || '.' || (event_id % 5) || ' */' WHEN 3 THEN '// @implements FR' || user_id || ' see notes' WHEN 4 THEN '# @implements Epic ' || (user_id % 11) || ',FRx' ELSE 'const x = 1;' END AS text FROM events)"""
