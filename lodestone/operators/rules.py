"""Line rules to findings with stable ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import excerpt, finding_id

#: The order of severities.
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def scan(lines: DataFrame, rules: list[tuple[str, str, str]], selected: list[str] | None = None) -> DataFrame:
    """(file, line, text) against (check, severity, text that must be in the line): findings.

    Rules are a fixed list, tried on each line without a join. An unknown name in `selected` is an error; none means all.
    """
    known = {c for c, _, _ in rules}
    if unknown := set(selected or ()) - known:
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
    active = [r for r in rules if not selected or r[0] in selected]
    hit = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(sign)), F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"))) for c, s, sign in active]))
    rows = lines.filter(reduce(lambda a, b: a | b, [F.contains("text", F.lit(sign)) for _, _, sign in active])).select("file", "line", excerpt(F.col("text")).alias("excerpt"), F.explode(hit).alias("r"))
    rows = rows.select("r.check", "r.severity", "file", "line", "excerpt")
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("severity")]
    return rows.select(finding_id(F.col("check"), F.col("file"), F.col("line"), F.col("excerpt")).alias("id"), "severity", rank.alias("rank"), "check", "file", "line", "excerpt")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rank", "file", "line")


def templates(lines: DataFrame, suffix: str = ".inker", sign: str = "{{{") -> DataFrame:
    """Lines of templates with raw output."""
    rows = lines.filter(F.col("file").endswith(suffix) & F.contains("text", F.lit(sign)))
    flat = F.trim(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\t"), F.lit("    ")))
    return rows.select("file", "line", F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 119), F.lit("…"))).otherwise(flat).alias("excerpt"))
