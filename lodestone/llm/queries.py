"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from lodestone.llm import bpe, licenses, lines, mixing, neardup, order, quality, sharding, urls, vectors

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_near_duplicates": neardup.query,
    "op3_licenses": licenses.query,
    "op4_line_dedup": lines.query,
    "op5_near_vectors": vectors.query,
    "op6_url_filter": urls.query,
    "op7_sharding": sharding.query,
    "op8_bpe": bpe.query,
    "op9_mixing": mixing.query,
    "op10_training_order": order.query,
}

SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_near_duplicates": neardup.SQL,
    "op5_near_vectors": vectors.SQL,
    "op6_url_filter": urls.SQL,
    "op7_sharding": sharding.SQL,
    "op9_mixing": mixing.SQL,
}
