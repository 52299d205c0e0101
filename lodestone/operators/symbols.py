"""Symbols, plan roots and versions: ranked lookups over small relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.trace import is_test
from lodestone.sources.typescript import tokenize

#: Words that declare a symbol, and its kind.
DECLARES = {"class": "class", "function": "function", "interface": "interface", "type": "type"}


def symbols(files: DataFrame) -> DataFrame:
    """(file, text) to (name, kind, file, line, signature) of the declarations at the top level of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                tokens, lines = tokenize(text or ""), (text or "").split("\n")
                i = 0
                while i < len(tokens) - 1:
                    t, n = tokens[i], tokens[i + 1]
                    if t.kind == "keyword" and t.text in DECLARES and n.kind == "name":
                        rows.append((n.text, DECLARES[t.text], file, t.line, lines[t.line - 1].strip()))
                    i = t.match if t.match > i else i
                    i += 1
            yield pd.DataFrame(rows, columns=["name", "kind", "file", "line", "signature"])

    return files.select("file", "text").mapInPandas(run, "name string, kind string, file string, line int, signature string")


def explained(found: DataFrame, name: str) -> DataFrame:
    """The declaration of a name: production files before tests; ambiguous if more than one is as good."""
    rows = found.filter(F.col("name") == name).withColumn("test", is_test(F.col("file")))
    best = rows.groupBy("test").agg(F.min_by(F.struct("name", "kind", "file", "line", "signature"), F.struct("file", "line")).alias("s"), F.count("*").alias("n"))
    return best.orderBy("test").limit(1).select("s.*", (F.col("n") > 1).alias("ambiguous"))


def plan_root(tiers: DataFrame) -> DataFrame:
    """(tier, path, exists) in the order of tier: every tier tried, and which one is taken."""
    taken = tiers.filter("exists").agg(F.min("tier").alias("taken"))
    return tiers.join(F.broadcast(taken)).withColumn("used", F.coalesce(F.col("tier") == F.col("taken"), F.lit(False))).drop("taken")


def versions_agree(packages: DataFrame, root_version: str | None) -> DataFrame:
    """(name, version, private): one row, whether every public package has the root's version, and which have not."""
    if root_version is None:
        return packages.sparkSession.createDataFrame([(True, [])], "clean boolean, differing array<string>")
    public = packages.filter(~F.coalesce("private", F.lit(False)) & F.col("version").isNotNull())
    differs = F.col("version") != root_version
    return public.agg(F.coalesce(F.bool_and(~differs), F.lit(True)).alias("clean"), F.array_sort(F.collect_list(F.when(differs, F.col("name")))).alias("differing"))
