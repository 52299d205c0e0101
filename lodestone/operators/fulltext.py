"""Ranked retrieval over chunks: BM25, phrases, filters, hybrid scores, diversity.

A query's phrases are counted inside each row; only three sums (rows, tokens, rows per phrase) are
gathered, so ranking needs no shuffle of the texts and the top rows are taken map-side. Scores are
doubles where an engine might use single precision, and ties go by id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import phrase_count, query_phrases, tokens

#: Term saturation, length normalisation, least idf, candidates, weights.
K1, B, LEAST_IDF, CANDIDATES, LEXICAL, VECTOR, DIVERSITY = 1.2, 0.75, 1e-6, 50, 0.4, 0.6, 0.7


def counted(chunks: DataFrame, phrases: list[list[str]], columns: tuple[str, ...] = ("heading", "body"), length: tuple[str, ...] = ("heading", "body")) -> DataFrame:
    """chunks with dl (tokens) and f0, f1, ... (occurrences of each phrase over `columns`)."""
    words = chunks.select("*", *[tokens(F.col(c)).alias(f"_{c}") for c in length])
    counts = [sum((phrase_count(F.col(f"_{c}"), p) for c in columns[1:]), phrase_count(F.col(f"_{columns[0]}"), p)).alias(f"f{k}") for k, p in enumerate(phrases)]
    return words.select("*", sum((F.size(f"_{c}") for c in length[1:]), F.size(f"_{length[0]}")).alias("dl"), *counts).drop(*[f"_{c}" for c in length])


def bm25(chunks: DataFrame, query: str, limit: int = CANDIDATES, columns: tuple[str, ...] = ("heading", "body"), rank_by: str = "id") -> DataFrame:
    """Rows that hold every phrase, best first, with bm25. A query with no phrase finds nothing."""
    phrases = query_phrases(query)
    if not phrases:
        return chunks.limit(0).withColumn("bm25", F.lit(0.0))
    rows = counted(chunks, phrases, columns)
    hits = [F.col(f"f{k}") > 0 for k in range(len(phrases))]
    stats = rows.agg(F.count("*").alias("rows"), F.avg("dl").alias("avgdl"), *[F.count_if(h).alias(f"n{k}") for k, h in enumerate(hits)])
    score: Column = F.lit(0.0)
    for k in range(len(phrases)):
        raw = F.log((F.col("rows") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
        f = F.col(f"f{k}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    every = hits[0]
    for h in hits[1:]:
        every = every & h
    # stats is one row.
    ranked = rows.filter(every).join(F.broadcast(stats)).select(*chunks.columns, F.round(score, 6).alias("bm25"))
    return ranked.orderBy(F.desc("bm25"), rank_by).limit(limit)


def search(chunks: DataFrame, query: str, package: str | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Candidates first, filters after them: a rare package may find nothing though it has matches."""
    found = bm25(chunks, query)
    if package is not None:
        found = found.filter(F.col("package") == package)
    if kind is not None:
        found = found.filter(F.lower("kind") == kind.lower())
    # At most CANDIDATES rows.
    rank = F.row_number().over(Window.orderBy(F.desc("bm25"), "id")) - 1
    return found.withColumn("score", F.lit(1.0) / (1 + rank)).orderBy(F.desc("score")).limit(max(1, min(50, limit)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors and for different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], package: str | None = None, kind: str | None = None) -> DataFrame:
    """Candidates with score = 0.4 reciprocal rank + 0.6 cosine moved to 0..1; no vector counts as cosine 0."""
    found = search(chunks, query, package, kind, CANDIDATES)
    vec = vectors.select(F.col("vec_id").alias("id"), "embedding")
    rows = vec.join(F.broadcast(found), "id", "right")  # at most CANDIDATES rows
    cos = F.coalesce(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), F.lit(0.0))
    top = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1e-6))
    score = LEXICAL * F.col("score") / top + VECTOR * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))
    return rows.select(*chunks.columns, "bm25", "embedding", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("bm25"), "id")


def diverse(scored: DataFrame, limit: int = 10) -> DataFrame:
    """Maximal marginal relevance over at most CANDIDATES rows (id, score, bm25, embedding): (place, id, score).

    The taken row's place in the list goes to the last one, which decides ties; the score is kept.
    """

    def cos(a, b) -> float:
        if a is None or b is None or len(a) != len(b) or not len(a):
            return 0.0
        na, nb = sum(float(x) * x for x in a) ** 0.5, sum(float(x) * x for x in b) ** 0.5
        return sum(float(x) * float(y) for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["score", "bm25", "id"], ascending=[False, False, True]).to_dict("records")
        out: list[dict] = []
        while left and len(out) < limit:
            values = [DIVERSITY * r["score"] - (1 - DIVERSITY) * max([0.0, *(cos(r["embedding"], s["embedding"]) for s in out)]) for r in left]
            best = max(range(len(left)), key=lambda k: (values[k], -k))
            out.append(left[best])
            left[best] = left[-1]
            left.pop()
        return pd.DataFrame({"place": range(len(out)), "id": [r["id"] for r in out], "score": [r["score"] for r in out]})

    return scored.select("id", "score", "bm25", "embedding").limit(CANDIDATES).groupBy().applyInPandas(pick, "place bigint, id bigint, score double")


def topic(chunks: DataFrame, words: str) -> DataFrame:
    """The best row whose heading holds the first word and which holds the others anywhere."""
    first, *rest = words.split() or [""]
    phrases = query_phrases(first)
    inside = chunks if not phrases else counted(chunks, phrases[:1], ("heading",)).filter("f0 > 0").drop("f0", "dl")
    ranked = bm25(chunks, words, limit=2**31 - 1)
    return ranked.join(inside.select("id"), "id", "left_semi").select(*ranked.columns).orderBy(F.desc("bm25"), "id").limit(1)


def get(chunks: DataFrame, id_: int) -> DataFrame:
    return chunks.filter(F.col("id") == id_)


def confidence(used_vectors: bool, vector_index: bool) -> str:
    return "high" if used_vectors and vector_index else "medium" if used_vectors else "low"
