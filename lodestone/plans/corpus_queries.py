"""Registered corpus, chunk and trace queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking, corpus, trace
from lodestone.plans.inputs import FILES, TRACE_LINES, corpus_files, old_snapshot, table, trace_lines


def corpus_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.classify(corpus_files(spark, sf_dir))
    return rows.filter(corpus.indexable(F.col("content"))).select("doc_id", "file", "kind", "package")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.packed(F.col("text"), "\n")).alias("part", "body")).select("doc_id", "part", F.length("body").alias("length"), F.md5("body").alias("body_md5"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    heading = F.array(F.element_at(F.split("content", "[ \n]"), 1), F.concat(F.lit("Part "), F.col("doc_id") % 3))
    rows = files.select("file", "doc_id", F.concat(tx.chunk_prefix(F.col("file"), F.col("content")), F.lit(":"), tx.slug_path(heading)).alias("id"), tx.content_hash(F.col("content")).alias("content_hash"))
    return chunking.numbered(rows, "file", "doc_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = corpus_files(spark, sf_dir)
    now = files.filter("doc_id % 7 <> 0").selectExpr("concat('f', doc_id) as file", "mtime", "doc_id", "content")
    return now, old_snapshot(files)


def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, state = _snapshots(spark, sf_dir)
    return corpus.merged(state.select("file", "mtime"), corpus.changes(now, state))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statistics(corpus.changes(*_snapshots(spark, sf_dir)))


def audit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("file"), "user_id", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500) / 1000).alias("mtime"))
    last = events.groupBy("file", "user_id").agg(F.max("mtime").alias("mtime"), F.min("mtime").alias("first"))
    state = last.selectExpr("file", "case when user_id % 3 = 0 then first else mtime end as mtime")
    return corpus.drift(state, last.filter("user_id % 10 <> 0"))


def trace_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.sites(trace_lines(spark, sf_dir))


def trace_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.index(trace_lines(spark, sf_dir)).select("requirement", "implementations", "tests", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"))


def trace_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.gaps(trace.index(trace_lines(spark, sf_dir))).select("requirement", "tests")


def trace_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.format_string("f%09d", "doc_id").alias("file"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return trace.within_budget(files, 300, 500_000)


QUERIES = {f.__name__: f for f in (corpus_classify, chunk_pack, chunk_ids, index_incremental, index_stats, audit_drift, trace_sites, trace_index, trace_gaps, trace_budget)}

_SITES = rf"""{TRACE_LINES},
marks AS (SELECT file, line, regexp_replace(substr(text, instr(text, '@implements') + 11), '\*/.*$', '') AS rest FROM trace_lines WHERE contains(text, '@implements')),
ids AS (SELECT file, line, trim(string_split(x, '(')[1]) AS requirement FROM (SELECT file, line, unnest(string_split(rest, ',')) AS x FROM marks)),
sites AS (SELECT requirement, file, line, contains(file, '/tests/') OR contains(file, '.test.') OR contains(file, '.spec.') AS is_test FROM ids
  WHERE regexp_matches(requirement, '^(FR[0-9]+|MISS-[0-9]+|Story [0-9]+(\.[0-9]+){{1,2}}|Epic [0-9]+)$')),
idx AS (SELECT requirement, count(*) FILTER (WHERE NOT is_test) AS implementations, count(*) FILTER (WHERE is_test) AS tests, min({{'file': file, 'line': line}}) AS f FROM sites GROUP BY 1)"""
_SNAP = f"""{FILES}, now AS (SELECT 'f' || doc_id AS file, mtime, content FROM files WHERE doc_id % 7 <> 0),
old AS (SELECT 'f' || doc_id AS file, CASE WHEN doc_id % 4 = 0 THEN mtime - 500 ELSE mtime END AS mtime FROM files WHERE doc_id % 5 <> 0),
ch AS (SELECT now.file, now.mtime, CASE WHEN NOT coalesce(strlen(content) <= 262144 AND trim(content) <> '', false) THEN 'skipped' WHEN old.mtime >= now.mtime THEN 'unchanged' ELSE 'indexed' END AS status FROM now LEFT JOIN old ON old.file = now.file)"""
SQL = {
    "corpus_classify": f"""WITH {FILES}, p AS (SELECT *, string_split(file, '/') AS p FROM files)
SELECT doc_id, file, CASE WHEN starts_with(file, '_bmad-output/planning-artifacts/adr-') AND len(p) = 3 THEN 'Adr' WHEN starts_with(file, '_bmad-output/planning-artifacts/') THEN 'Bmad' WHEN p[-1] = 'README.md' THEN 'Readme' ELSE 'Markdown' END AS kind,
  CASE WHEN p[1] = 'packages' AND len(p) > 2 THEN p[2] END AS package FROM p
WHERE ends_with(file, '.md') AND (file = 'README.md' OR (p[1] = 'docs' AND len(p) > 1) OR (p[1] = 'packages' AND len(p) = 3 AND p[3] IN ('README.md', 'CORRECTIONS.md')) OR starts_with(file, '_bmad-output/planning-artifacts/'))
  AND strlen(content) <= 262144 AND trim(content) <> ''""",
    "chunk_pack": """WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
r AS (
  SELECT doc_id, ps, 0 AS k, 0 AS part, '' AS buffer, NULL::VARCHAR AS done FROM d WHERE len(text) > 2048
  UNION ALL
  SELECT doc_id, ps, k + 1, CASE WHEN f THEN part + 1 ELSE part END, CASE WHEN b = '' THEN ps[k + 1] ELSE b || chr(10) || ps[k + 1] END, CASE WHEN f THEN buffer END
  FROM (SELECT *, CASE WHEN f THEN right(buffer, 200) ELSE buffer END AS b FROM (SELECT *, len(buffer) + len(ps[k + 1]) > 2048 AND buffer <> '' AS f FROM r WHERE k < len(ps)))),
o AS (SELECT doc_id, 0 AS part, text AS body FROM d WHERE len(text) <= 2048
  UNION ALL SELECT doc_id, part - 1, trim(done, ' ') FROM r WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, part, trim(buffer, ' ') FROM r WHERE k = len(ps) AND trim(buffer, ' ') <> '')
SELECT doc_id, part, len(body)::INT AS length, md5(body) AS body_md5 FROM o""",
    "chunk_ids": rf"""WITH {FILES}, h AS (SELECT file, doc_id, sha256(file || chr(0) || content) AS whole, sha256(content) AS c, [regexp_split_to_array(content, '[ \n]')[1], 'Part ' || (doc_id % 3)] AS hs FROM files),
s AS (SELECT *, list_transform(hs, lambda x: regexp_replace(lower(regexp_replace(x, '[^A-Za-z0-9]+', '-', 'g')), '^-|-$', '', 'g')) AS slugs FROM h),
i AS (SELECT file, doc_id, whole[1:32] || ':' || array_to_string(list_transform(slugs, lambda x: CASE WHEN x = '' THEN 'x' ELSE x END), '>') AS id,
  array_to_string(list_transform(range(8), lambda k: substr(c, 15 - 2 * k, 2)), '') AS le FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY file, id ORDER BY doc_id) AS nth FROM i)
SELECT file, doc_id, CASE WHEN nth > 1 THEN id || '~' || nth ELSE id END AS id, CASE WHEN ltrim(le, '0') = '' THEN '0' ELSE ltrim(le, '0') END AS content_hash FROM n""",
    "index_incremental": f"WITH {_SNAP} SELECT file, mtime FROM ch WHERE status = 'indexed' UNION ALL SELECT file, mtime FROM old WHERE file NOT IN (SELECT file FROM ch WHERE status = 'indexed')",
    "index_stats": f"WITH {_SNAP} SELECT count(*) AS files_scanned, count(*) FILTER (WHERE status = 'indexed') AS files_indexed, count(*) FILTER (WHERE status = 'unchanged') AS files_unchanged, count(*) FILTER (WHERE status = 'skipped') AS files_skipped, 0::BIGINT AS files_failed FROM ch",
    "audit_drift": """WITH l AS (SELECT 'u' || user_id AS file, user_id, ((epoch_us(max(ts)) + 500) // 1000)::BIGINT AS mtime, ((epoch_us(min(ts)) + 500) // 1000)::BIGINT AS first FROM events GROUP BY user_id),
s AS (SELECT file, CASE WHEN user_id % 3 = 0 THEN first ELSE mtime END AS stored_mtime FROM l),
j AS (SELECT s.file, stored_mtime, coalesce(l.mtime, -1) AS current_mtime FROM s LEFT JOIN l ON l.file = s.file AND l.user_id % 10 <> 0)
SELECT * FROM j WHERE current_mtime > stored_mtime OR current_mtime = -1""",
    "trace_sites": f"WITH {_SITES} SELECT * FROM sites",
    "trace_index": f"WITH {_SITES} SELECT requirement, implementations, tests, f.file AS first_file, f.line AS first_line FROM idx",
    "trace_gaps": f"WITH {_SITES} SELECT requirement, tests FROM idx WHERE implementations = 0",
    "trace_budget": """WITH f AS (SELECT printf('f%09d', doc_id) AS file, strlen(coalesce(text, ''))::BIGINT AS size FROM documents),
w AS (SELECT *, row_number() OVER (ORDER BY file) AS n, sum(size) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING) AS b FROM f) SELECT file, size FROM w WHERE n <= 300 AND b <= 500000""",
}
