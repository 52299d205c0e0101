"""Sections of Markdown documents and their stable ids.

Sections end at each level-2 or level-3 heading; the packer cuts long bodies at paragraph borders and
repeats the tail of the part before. The packer is a fold over the paragraphs, on the JVM; the
sectioniser is sequential per file and runs over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longest body and repeated tail, in characters.
MOST, OVERLAP = 2048, 200
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def packed(body: Column, between: str = "\n\n", most: int = MOST, overlap: int = OVERLAP) -> Column:
    """The parts of a body, in order; a body that is not too long is one part. A single long paragraph is never cut."""

    def step(acc: Column, paragraph: Column) -> Column:
        buffer = acc["buffer"]
        full = (F.length(buffer) + F.length(paragraph) > most) & (buffer != "")
        kept = F.when(full, F.right(buffer, F.lit(overlap))).otherwise(buffer)
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(F.trim(buffer)))).otherwise(acc["parts"]).alias("parts"),
            F.when(kept == "", paragraph).otherwise(F.concat(kept, F.lit(between), paragraph)).alias("buffer"),
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("buffer"))
    cut = F.aggregate(F.split(body, between), start, step, lambda acc: F.when(F.trim(acc["buffer"]) == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.trim(acc["buffer"])))))
    return F.when(F.length(body) > most, cut).otherwise(F.array(body))


def numbered(chunks: DataFrame, by: str = "file", order: str = "ordinal") -> DataFrame:
    """The n-th chunk of a file with the same id, n > 1, gets ~n."""
    nth = F.row_number().over(Window.partitionBy(by, "id").orderBy(order))
    return chunks.withColumn("id", F.when(nth > 1, F.concat("id", F.lit("~"), nth)).otherwise(F.col("id")))


def sections(text: str) -> Iterator[tuple[list[str], str, int, int]]:
    """(heading path, body, first line, last line) of each section of a Markdown text that has a body."""
    stack: list[tuple[int, str]] = []
    path: list[str] = []
    body: list[str] = []
    start, fence = 1, ""

    def flush(end: int) -> Iterator[tuple[list[str], str, int, int]]:
        whole = "\n".join(body).strip()
        body.clear()
        if whole:
            yield list(path), whole, start, max(start, end)

    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip(" `~"):
                fence = ""
                body.append("")
            else:
                body.append(line)
            continue
        if mark:
            fence = mark[1]
            continue
        if not (heading := HEADING.match(line)):
            body.append(line)
            continue
        level = len(heading[1])
        if level in (2, 3):
            yield from flush(no)
            start = no
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, (heading[2] or "").strip()))
        path[:] = [t for _, t in stack]
    yield from flush(len(lines))


def sectionise(files: DataFrame) -> DataFrame:
    """(file, content) to (file, ordinal, heading_path, body, line_start, line_end), whole files at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, *s) for f, t in zip(pdf["file"], pdf["content"], strict=True) if t is not None for k, s in enumerate(sections(t))]
            yield pd.DataFrame(rows, columns=["file", "ordinal", "heading_path", "body", "line_start", "line_end"])

    return files.select("file", "content").mapInPandas(run, "file string, ordinal int, heading_path array<string>, body string, line_start int, line_end int")


def chunked(files: DataFrame) -> DataFrame:
    """Sections, packed, with ids: file prefix, slugs of the path, #part and ~n where needed."""
    from lodestone.functions.text import chunk_prefix, slug_path

    keyed = files.select("file", chunk_prefix(F.col("file"), F.col("content")).alias("prefix"))
    rows = sectionise(files).join(keyed, "file")
    parts = rows.select("*", F.posexplode(packed(F.col("body"))).alias("part", "piece"), (F.length("body") > MOST).alias("cut"))
    path = F.when(F.col("cut"), F.concat("heading_path", F.array(F.concat(F.lit("part-"), F.col("part"))))).otherwise(F.col("heading_path"))
    base = F.concat("prefix", F.lit(":"), slug_path(F.col("heading_path")))
    ids = parts.select("file", (F.col("ordinal") * 100000 + F.col("part")).alias("ordinal"), F.when(F.col("cut"), F.concat(base, F.lit("#"), F.col("part"))).otherwise(base).alias("id"), path.alias("heading_path"), F.col("piece").alias("body"), "line_start", "line_end")
    return numbered(ids)
