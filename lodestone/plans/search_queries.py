"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fulltext as ft
from lodestone.plans.inputs import CHUNKS, chunks, table

OUT = ("id", "package", "kind", "bm25")


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.search(chunks(spark, sf_dir), "licensed under", limit=50).select(*OUT, F.round("score", 6).alias("score"))


def search_filter_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.search(chunks(spark, sf_dir), "that the", package="src3", kind="markdown", limit=50).select(*OUT, F.round("score", 6).alias("score"))


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.search(chunks(spark, sf_dir), "under apache-license", limit=50).select(*OUT, F.round("score", 6).alias("score"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.hybrid(chunks(spark, sf_dir), table(spark, sf_dir, "embeddings"), "that this", first_vector(spark, sf_dir)).select(*OUT, "score")


def search_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.diverse(ft.hybrid(chunks(spark, sf_dir), table(spark, sf_dir, "embeddings"), "that this", first_vector(spark, sf_dir)))


def topic_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.topic(chunks(spark, sf_dir), "corpus licensed").select(*OUT)


def chunk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.get(chunks(spark, sf_dir), 7).select("id", "package", "kind", F.md5("body").alias("body_md5"))


def ranked_sql(phrases: list[list[str]], limit: int | None = 50, where: str = "TRUE") -> str:
    """CTEs up to `hits` (id, package, kind, bm25), at most `limit` of them."""
    count = lambda col, p: "len(list_filter(range(1, len({c}) + 1), lambda i: {t}))".format(c=col, t=" AND ".join(f"coalesce({col}[i + {k}] = '{w}', false)" for k, w in enumerate(p)))
    fs = ", ".join(f"{count('h', p)} + {count('b', p)} AS f{k}" for k, p in enumerate(phrases))
    ns = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(len(phrases)))
    idf = lambda k: f"(CASE WHEN ln((rows - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows - n{k} + 0.5) / (n{k} + 0.5)) END)"
    score = " + ".join(f"{idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(phrases)))
    return f"""WITH {CHUNKS},
w AS (SELECT *, regexp_extract_all(strip_accents(lower(coalesce(heading, ''))), '[\\p{{L}}\\p{{N}}]+') AS h, regexp_extract_all(strip_accents(lower(coalesce(body, ''))), '[\\p{{L}}\\p{{N}}]+') AS b FROM chunks),
f AS (SELECT *, (len(h) + len(b))::DOUBLE AS dl, {fs} FROM w),
st AS (SELECT count(*)::DOUBLE AS rows, avg(dl) AS avgdl, {ns} FROM f),
hits AS (SELECT id, package, kind, round({score}, 6) AS bm25 FROM f, st WHERE {" AND ".join(f"f{k} > 0" for k in range(len(phrases)))} AND {where} ORDER BY bm25 DESC, id {f"LIMIT {limit}" if limit else ""})"""


RANKED = "SELECT id, package, kind, bm25, round(1.0 / row_number() OVER (ORDER BY bm25 DESC, id), 6) AS score FROM hits"

QUERIES = {
    "search_bm25": search_bm25,
    "search_filter_after_limit": search_filter_after_limit,
    "search_phrase": search_phrase,
    "search_hybrid": search_hybrid,
    "search_mmr": search_mmr,
    "topic_top1": topic_top1,
    "chunk_get": chunk_get,
}
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
SQL = {
    "search_bm25": f"{ranked_sql([['licensed'], ['under']])} {RANKED}",
    "search_filter_after_limit": f"{ranked_sql([['that'], ['the']])} {RANKED} WHERE package = 'src3' AND lower(kind) = 'markdown'",
    "search_phrase": f"{ranked_sql([['under'], ['apache', 'license']])} {RANKED}",
    "search_hybrid": f"""{ranked_sql([['that'], ['this']])},
r AS (SELECT *, 1.0::DOUBLE / row_number() OVER (ORDER BY bm25 DESC, id) AS s FROM hits),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
j AS (SELECT r.*, embedding AS e, q.q FROM r LEFT JOIN embeddings ON vec_id = id, q)
SELECT id, package, kind, bm25, round(0.4 * s / greatest(max(s) OVER (), 1e-6) + 0.6 * greatest(0.0, least(1.0, (coalesce({_DOT('e', 'q')} / (sqrt({_DOT('e', 'e')}) * sqrt({_DOT('q', 'q')})), 0) + 1) / 2)), 6) AS score FROM j""",
    "topic_top1": f"{ranked_sql([['corpus'], ['licensed']], None)} SELECT * FROM hits ORDER BY bm25 DESC, id LIMIT 1",
    "chunk_get": f"WITH {CHUNKS} SELECT id, package, kind, md5(body) AS body_md5 FROM chunks WHERE id = 7",
}
