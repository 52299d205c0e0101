"""The document corpus: which files belong, what they are, and what changed.

State lives in tables, one version per run: a run joins the listing with the last state, replaces the
chunks of changed files and leaves the rest. Only mtimes decide what changed; files that vanish keep
their chunks until a full rebuild, and drift reports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash, slashes

#: Folders that are never entered, the planning folder, the largest document in bytes, the mtime of a missing file.
SKIPPED = ("node_modules", "target", "dist", "build", "coverage", "vendor")
PLANNING, MAX_BYTES, GONE = "_bmad-output/planning-artifacts", 256 * 1024, -1


def parts(file: Column) -> Column:
    return F.split(slashes(file), "/")


def skipped(file: Column) -> Column:
    """Inside a folder that is skipped by name, or whose name begins with a dot."""
    folders = F.slice(parts(file), 1, F.size(parts(file)) - 1)
    return F.exists(folders, lambda p: p.isin(*SKIPPED) | p.startswith("."))


def allowed(file: Column) -> Column:
    """The four shapes of paths that belong to the corpus."""
    p = parts(file)
    n, last = F.size(p), F.element_at(p, -1)
    package = (p[0] == "packages") & (n == 3) & last.isin("README.md", "CORRECTIONS.md")
    return slashes(file).endswith(".md") & ((slashes(file) == "README.md") | ((p[0] == "docs") & (n > 1)) | F.coalesce(package, F.lit(False)) | slashes(file).startswith(PLANNING + "/"))


def kind(file: Column) -> Column:
    f, last = slashes(file), F.element_at(parts(file), -1)
    direct = f.startswith(PLANNING + "/adr-") & (F.size(parts(file)) == len(PLANNING.split("/")) + 1)
    return F.when(direct, "Adr").when(f.startswith(PLANNING + "/"), "Bmad").when(last == "README.md", "Readme").otherwise("Markdown")


def package(file: Column) -> Column:
    p = parts(file)
    return F.when((p[0] == "packages") & (F.size(p) > 2), F.get(p, 1))


def classify(files: DataFrame) -> DataFrame:
    """Files of the corpus with kind and package."""
    return files.filter(allowed(F.col("file")) & ~skipped(F.col("file"))).withColumns({"kind": kind(F.col("file")), "package": package(F.col("file"))})


def indexable(content: Column) -> Column:
    """Neither too large nor empty nor null."""
    return F.coalesce((F.octet_length(content) <= MAX_BYTES) & (F.trim(content) != ""), F.lit(False))


def changes(files: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """files with status: skipped (cannot be indexed), unchanged (its state is as new) or indexed."""
    last = state.select(F.col("file").alias("_f"), F.col("mtime").alias("_m"))
    status = F.when(~indexable(F.col("content")), "skipped")
    if not full:
        status = status.when(F.col("_m") >= F.col("mtime"), "unchanged")
    return files.join(last, F.col("file") == F.col("_f"), "left").withColumn("status", status.otherwise("indexed")).drop("_f", "_m")


def merged(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The next version of a table keyed by file: rows of changed files replaced, the rest kept."""
    new = changed.filter("status = 'indexed'").select(*state.columns)
    return state.join(new.select("file").distinct(), "file", "left_anti").select(*state.columns).unionByName(new)


def deleted(state: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The next version of a table keyed by file without the rows of `files`; without any row if none are named."""
    return state.limit(0) if files is None else state.join(files.select("file").distinct(), "file", "left_anti").select(*state.columns)


def collisions(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Files with a chunk id that another file already owns: they fail alone."""
    owned = state.select("id", F.col("file").alias("owner"))
    return chunks.join(owned, "id").filter("file <> owner").select("file").distinct()


def failed(changed: DataFrame, clashes: DataFrame) -> DataFrame:
    """files with status, those of `clashes` (see collisions) failed instead of indexed: they alone."""
    return changed.join(clashes.select(F.col("file").alias("_f")).distinct(), F.col("file") == F.col("_f"), "left").withColumn("status", F.when((F.col("status") == "indexed") & F.col("_f").isNotNull(), "failed").otherwise(F.col("status"))).drop("_f")


def tracked(files: DataFrame) -> DataFrame:
    """The state row of each file."""
    return files.select("file", "mtime", content_hash(F.col("content")).alias("content_hash"))


def statistics(changed: DataFrame) -> DataFrame:
    """One row with the number of files by outcome."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return changed.agg(F.count("*").alias("files_scanned"), is_("indexed").alias("files_indexed"), is_("unchanged").alias("files_unchanged"), is_("skipped").alias("files_skipped"), is_("failed").alias("files_failed"))


def drift(state: DataFrame, disk: DataFrame) -> DataFrame:
    """Tracked files that are newer on disk, or gone (-1)."""
    now = disk.select(F.col("file"), F.col("mtime").alias("current_mtime"))
    rows = state.select("file", F.col("mtime").alias("stored_mtime")).join(now, "file", "left").withColumn("current_mtime", F.coalesce("current_mtime", F.lit(GONE)))
    return rows.filter((F.col("current_mtime") > F.col("stored_mtime")) | (F.col("current_mtime") == GONE))
