"""File scans and small structured readers as DataFrames.

Paths are read by Spark, so any store it knows will do; relative paths use forward slashes.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.corpus import MAX_BYTES, PLANNING, SKIPPED, classify
from lodestone.operators.trace import MAX_FILES, MAX_TOTAL, within_budget

#: Application folders of a trace scan, suffixes of sources, size caps, order of the first places.
SOURCE_SUFFIXES = (".ts", ".tsx", ".mts", ".cts")
COVERAGE_MOST, FILES_MOST = 1_000_000, 5000
PARTS = ("lines", "branches", "functions", "statements")


def files(spark: SparkSession, root: str, glob: str = "*", most: int = MAX_BYTES) -> DataFrame:
    """(file, size, mtime, text) below root, without skipped folders; text is null if too large or not UTF-8.

    Sizes and times are filtered before contents are read.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    # Spark's listing passes over names that begin with _, unless they are asked for.
    hidden = spark._jvm.org.apache.hadoop.fs.Path(base, PLANNING.split("/")[0])
    roots = [root, *([hidden.toString()] if store.exists(hidden) else [])]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    full = store.makeQualified(base).toString().rstrip("/") + "/"
    relative = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(full.replace("file:///", "file:/")) + 1, 1 << 20)
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    kept = raw.filter(~F.exists(folders, lambda p: p.isin(*SKIPPED) | p.startswith(".")))
    text = F.when((F.col("length") <= most) & F.call_function("is_valid_utf8", F.col("content").cast("string")), F.col("content").cast("string"))
    return kept.select(relative.alias("file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), text.alias("text"))


def inside(candidate: str, root: str) -> bool:
    """Whether a path, links followed, is root or below it; for paths of this machine."""
    real, base = os.path.realpath(candidate), os.path.realpath(root)
    return real == base or real.startswith(base.rstrip(os.sep) + os.sep)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """The Markdown files that belong to the corpus: (file, mtime, content, kind, package)."""
    return classify(files(spark, root, "*.md").select("file", "mtime", F.col("text").alias("content")))


def sources(spark: SparkSession, root: str) -> DataFrame:
    """TypeScript files, declarations left out: (file, size, text)."""
    suffix = F.lit(False)
    for s in SOURCE_SUFFIXES:
        suffix = suffix | F.col("file").endswith(s)
    return files(spark, root, "*.*ts*").filter(suffix & ~F.col("file").endswith(".d.ts")).select("file", "size", "text")


def traced_lines(found: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL) -> DataFrame:
    """Lines of the sources within the budget: (file, line, text)."""
    return within_budget(found.filter("text is not null"), max_files, max_total).select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def coverage(text: Column) -> Column:
    """The four percentages of a coverage summary, to one decimal; null if any is missing or not finite or the text is too long."""
    schema = T.StructType([T.StructField("total", T.StructType([T.StructField(p, T.StructType([T.StructField("pct", T.DoubleType())])) for p in PARTS]))])
    total = F.from_json(text, schema)["total"]
    good = F.length(text) <= COVERAGE_MOST
    for p in PARTS:
        pct = total[p]["pct"]
        good = good & pct.isNotNull() & ~F.isnan(pct) & (F.abs(pct) < float("inf"))
    return F.when(good, F.struct(*[F.round(total[p]["pct"], 1).alias(p) for p in PARTS]))


def packages(manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """(dir, text) of package.json files and (file) to (name, dir, entry): main, module, types, then the usual places; the first that exists."""
    schema = "name string, main string, module string, types string"
    parsed = manifests.select("dir", F.from_json("text", schema).alias("m")).filter("m.name is not null").select("dir", "m.*")
    strip = lambda c: F.regexp_replace(c, r"^\./", "")
    tried = F.array(F.lit("src/index.ts"), F.lit("src/index.tsx"), strip(F.col("main")), strip(F.col("module")), strip(F.col("types")), F.lit("index.ts"), F.lit("index.tsx"), F.lit("src/main.ts"), F.lit("main.ts"))
    rows = parsed.select("name", "dir", F.posexplode(tried).alias("priority", "entry")).filter("entry is not null").withColumn("file", F.concat_ws("/", F.nullif("dir", F.lit("")), "entry"))
    # Both sides grow with the input: a size guessed from a compressed file would send them through the driver.
    found = rows.join(listing.select("file").hint("merge"), "file").groupBy("name", "dir").agg(F.min_by("file", "priority").alias("entry"))
    return parsed.select("name", "dir").join(found.hint("merge"), ["name", "dir"], "left")


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, content) against (file, size, sha256): the files that differ or are missing."""
    now = found.select("file", F.octet_length("content").alias("got_size"), F.sha2("content", 256).alias("got_sha256"))
    rows = manifest.join(now, "file", "left")
    return rows.filter(F.col("got_size").isNull() | (F.col("got_size") != F.col("size")) | (F.col("got_sha256") != F.col("sha256"))).select("file", F.when(F.col("got_size").isNull(), "missing").when(F.col("got_size") != F.col("size"), "size").otherwise("sha256").alias("reason"))


def templates(spark: SparkSession, root: str, most: int = FILES_MOST) -> DataFrame:
    """Template files by name, at most `most`: a row beyond that tells that there are more."""
    return files(spark, root, "*.inker").select("file", "size").orderBy("file").limit(most + 1)
