"""Plans: epics and stories from headings, their status, what is missing and what comes next."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Heading forms and the statuses a story may have.
EPIC = r"^\s*##\s+(?:[^A-Za-z\s#]+\s+)?Epic\s+([0-9]+)\s*:\s*(.*?)\s*(?:\[([^\]]*)\])?\s*$"
STORY = r"^\s*###\s+(?:[^A-Za-z\s#]+\s+)?Story\s+([0-9]+)\.([0-9]+)\s*:\s*(.*?)\s*(?:\[([^\]]*)\])?\s*$"
STATUSES = ("backlog", "ready-for-dev", "in-progress", "review", "done")
BLOCK = "development_status:"


def headings(lines: DataFrame, plan: str = "plan") -> DataFrame:
    """(plan, line, text) to epic and story headings outside fences, with the epic that is open and the last line of each.

    One plan is one file; its lines are ordered within it.
    """
    order = Window.partitionBy(plan).orderBy("line")
    fence = F.col("text").rlike(r"^\s*(```|~~~)").cast("int")
    rows = lines.withColumn("_fence", F.sum(fence).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("_fence") % 2 == 0) & (fence == 0))
    part = lambda pattern, k: F.regexp_extract("text", pattern, k)
    epic, story = part(EPIC, 1), part(STORY, 1)
    found = rows.select(
        plan, "line", F.when(epic != "", F.lit("epic")).when(story != "", F.lit("story")).alias("kind"),
        F.when(epic != "", epic).otherwise(story).try_cast("int").alias("epic"), part(STORY, 2).try_cast("int").alias("number"),
        F.when(epic != "", part(EPIC, 2)).otherwise(part(STORY, 3)).alias("title"), F.nullif(F.when(epic != "", part(EPIC, 3)).otherwise(part(STORY, 4)), F.lit("")).alias("badge"),
    )
    found = found.filter("kind is not null")
    opened = F.last(F.when(F.col("kind") == "epic", F.col("epic")), True).over(order)
    return found.withColumn("open", opened)


def epics(found: DataFrame, ends: DataFrame, plan: str = "plan") -> DataFrame:
    """Epics with their last line (before the next epic; ends: (plan, last_line))."""
    order = Window.partitionBy(plan).orderBy("line")
    rows = found.filter("kind = 'epic'").withColumn("_next", F.lead("line").over(order)).join(ends, plan)
    return rows.select(plan, "epic", "title", "badge", F.col("line").alias("start_line"), F.coalesce(F.col("_next") - 1, "last_line").alias("end_line"))


def stories(found: DataFrame, ends: DataFrame, plan: str = "plan") -> DataFrame:
    """Stories of the open epic with their last line (before the next heading); orphans are dropped."""
    order = Window.partitionBy(plan).orderBy("line")
    rows = found.withColumn("_next", F.lead("line").over(order)).filter("kind = 'story' and epic = open").join(ends, plan)
    return rows.select(plan, "epic", "number", "title", "badge", F.col("line").alias("start_line"), F.coalesce(F.col("_next") - 1, "last_line").alias("end_line"))


def statuses(lines: DataFrame, plan: str = "plan") -> DataFrame:
    """(plan, line, text) of a status file to (plan, key, value, position): the indented pairs of the status block; the last value and the first place of a key count."""
    order = Window.partitionBy(plan).orderBy("line")
    top = F.when(~F.col("text").rlike(r"^\s") & (F.trim("text") != "") & ~F.col("text").startswith("#"), F.trim("text") == BLOCK)
    inside = lines.withColumn("_in", F.last(top, True).over(order)).filter("_in")
    pair = r"^\s+([A-Za-z0-9_-]+):\s*([^\s#]*)"
    rows = inside.select(plan, "line", F.regexp_extract("text", pair, 1).alias("key"), F.regexp_extract("text", pair, 2).alias("value")).filter("key <> ''")
    return rows.groupBy(plan, "key").agg(F.max_by("value", "line").alias("value"), F.min("line").alias("position"))


def story_status(rows: DataFrame, found: DataFrame, plan: str = "plan") -> DataFrame:
    """Stories with the value of the first key that begins with epic-number-, else the badge, else backlog."""
    prefix = F.regexp_extract("key", r"^(\d+-\d+)-", 1)
    first = found.withColumn("_prefix", prefix).filter("_prefix <> ''").groupBy(plan, "_prefix").agg(F.min_by("value", "position").alias("_value"))
    keyed = rows.withColumn("_prefix", F.concat_ws("-", "epic", "number")).join(first, [plan, "_prefix"], "left")
    return keyed.withColumn("status", F.coalesce(F.nullif("_value", F.lit("")), "badge", F.lit("backlog"))).drop("_prefix", "_value")


def epic_status(rows: DataFrame, found: DataFrame, plan: str = "plan") -> DataFrame:
    keys = found.select(plan, F.col("key").alias("_key"), F.col("value").alias("_value"))
    keyed = rows.withColumn("_key", F.concat(F.lit("epic-"), "epic")).join(keys, [plan, "_key"], "left")
    return keyed.withColumn("status", F.coalesce(F.nullif("_value", F.lit("")), "badge", F.lit("backlog"))).drop("_key", "_value")


def next_story(rows: DataFrame, plan: str = "plan", epic: int | None = None) -> DataFrame:
    """Per plan the first story (of one epic, if given) that is not done, by numbers."""
    if epic is not None:
        rows = rows.filter(F.col("epic") == epic)
    return rows.filter("status <> 'done'").groupBy(plan).agg(F.min_by(F.struct("epic", "number", "title", "status"), F.struct("epic", "number")).alias("s")).select(plan, "s.*")


def story_refs(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, text) to distinct (file, id): maximal runs of digits and dots, so 33.7. is no reference."""
    return files.select("file", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9.]+"), F.lit(0)))).alias("id"))


def mentions(text: Column, requirement: Column) -> Column:
    """FR-7 stands in FR-7.1 but not in FR-70."""
    return F.call_function("rlike", text, F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), requirement, F.lit(r"([^0-9]|$)")))


#: An id of a requirement, and the names of test files.
REQUIREMENT, TEST_FILE = r"N?FR-[0-9]+(?:\.[0-9]+)*", r"\.(?:test|spec|fixture)\.tsx?$"


def unmentioned(requirements: DataFrame, lines: DataFrame) -> DataFrame:
    """Requirements (id, ...) that no line (text) mentions; FR-7.1 mentions FR-7 too."""
    ids = lines.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z0-9_]){REQUIREMENT}"), F.lit(0))).alias("id")).distinct()
    steps = F.split("id", r"\.")
    named = ids.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))).alias("id"))
    return requirements.join(named.distinct(), "id", "left_anti")


def is_test_file(file: Column) -> Column:
    return F.substring_index(file, "/", -1).rlike(TEST_FILE)


def story_gaps(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Stories (epic, number, ...) that no code or no test names, with columns in_code and in_tests; files: (file, text)."""
    refs = story_refs(files).groupBy("id").agg(F.max(~is_test_file(F.col("file"))).alias("in_code"), F.max(is_test_file(F.col("file"))).alias("in_tests"))
    keyed = rows.withColumn("id", F.concat_ws(".", "epic", "number")).join(refs, "id", "left")
    return keyed.withColumn("in_code", F.coalesce("in_code", F.lit(False))).withColumn("in_tests", F.coalesce("in_tests", F.lit(False))).filter("not (in_code and in_tests)").drop("id")


def requirement_trace(requirement: str, lines: DataFrame, ends: DataFrame, found: DataFrame, files: DataFrame, plan: str = "plan") -> DataFrame:
    """(kind, place, id, line) of the epics, stories, code and test files that mention a requirement, each with its first such line.

    lines, ends and found: a plan's lines, last lines and headings; place is the plan, or the file. A story's lines are its epic's too.
    """
    says = lambda text: mentions(text, F.lit(re.escape(requirement)))
    hits = lines.filter(says(F.col("text"))).select(F.col(plan).alias("_plan"), F.col("line").alias("_line"))
    held = lambda rows: rows.join(hits, (rows[plan] == hits["_plan"]) & F.col("_line").between(F.col("start_line"), F.col("end_line")))
    first = F.min("_line").cast("int").alias("line")
    place = F.col(plan).cast("string").alias("place")
    of_epics = held(epics(found, ends, plan)).groupBy(F.lit("epic").alias("kind"), place, F.col("epic").cast("string").alias("id"), "start_line").agg(first).drop("start_line")
    of_stories = held(stories(found, ends, plan)).groupBy(F.lit("story").alias("kind"), place, F.concat_ws(".", "epic", "number").alias("id"), "start_line").agg(first).drop("start_line")
    texts = files.filter(says(F.col("text"))).select("file", F.posexplode(F.split("text", "\n")).alias("_line", "text")).filter(says(F.col("text")))
    of_files = texts.groupBy(F.when(is_test_file(F.col("file")), "test").otherwise("code").alias("kind"), F.col("file").alias("place"), F.lit("").alias("id")).agg((F.min("_line") + 1).cast("int").alias("line"))
    return of_epics.unionByName(of_stories).unionByName(of_files)


def requirement_ids(lines: DataFrame) -> DataFrame:
    """(file_order, file, line, text) to (id, file, line) of the first place of each requirement."""
    rows = lines.select("file_order", "file", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\bN?FR-[0-9]+(?:\.[0-9]+)*"), F.lit(0))).alias("id"))
    return rows.groupBy("id").agg(F.min_by(F.struct("file", "line"), F.struct("file_order", "line")).alias("s")).select("id", "s.*")


#: An id of a story, and what a key of the status file is made of.
STORY_ID, KEY = r"[0-9]+\.[0-9]+", r"[A-Za-z0-9_-]+"


def story_texts(rows: DataFrame, lines: DataFrame, plan: str = "plan") -> DataFrame:
    """Stories (start_line, end_line, ...) with `body`: their lines of the plan, heading included."""
    own = lines.select(F.col(plan).alias("_plan"), F.col("line").alias("_line"), F.col("text").alias("_text"))
    inside = rows.join(own, (rows[plan] == own["_plan"]) & F.col("_line").between(F.col("start_line"), F.col("end_line")))
    by_line = F.array_sort(F.collect_list(F.struct("_line", "_text")))
    return inside.groupBy(*rows.columns).agg(F.array_join(F.transform(by_line, lambda x: x["_text"]), "\n").alias("body"))


def artifacts(files: DataFrame) -> DataFrame:
    """(file, text) of files named N-M-....md to (id, title, status, body, file); the first file of an id counts."""
    name = F.regexp_extract("file", r"([0-9]+)-([0-9]+)-[^/]*\.md$", 0)
    part = lambda k: F.regexp_extract("file", r"(?:^|/)([0-9]+)-([0-9]+)-[^/]*\.md$", k)
    status, title = F.regexp_extract("text", r"(?m)^Status:[ \t]*(\S+)", 1), F.regexp_extract("text", r"(?m)^#[ \t]+(.+?)[ \t\r]*$", 1)
    rows = files.filter((name != "") & (part(1) != "")).select(F.concat_ws(".", part(1), part(2)).alias("id"), "file", F.struct(title.alias("title"), F.when(status != "", status).otherwise("unknown").alias("status"), F.col("text").alias("body"), F.col("file").alias("file")).alias("s"))
    return rows.groupBy("id").agg(F.min_by("s", "file").alias("s")).select("id", "s.*")


def get_story(story_id: str, own: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (source, id, title, status, body) at most: the story's own file (see artifacts), else its part of the plan (rows: epic, number, title, status, body)."""
    if not re.fullmatch(STORY_ID, story_id):
        raise ValueError("a story's id is two numbers with a dot between, like 33.7")
    columns = ("source", "id", "title", "status", "body")
    first = own.filter(F.col("id") == story_id).select(F.lit("implementation-artifact").alias("source"), "id", "title", "status", "body")
    planned = rows.select(F.lit("epic-section").alias("source"), F.concat_ws(".", "epic", "number").alias("id"), "title", "status", "body").filter(F.col("id") == story_id)
    return first.withColumn("rank", F.lit(0)).unionByName(planned.withColumn("rank", F.lit(1))).groupBy("id").agg(F.min_by(F.struct(*columns), "rank").alias("s")).select("s.*")


def rewritten_status(lines: DataFrame, key: str, value: str, plan: str | None = None) -> DataFrame:
    """(line, text), or (plan, line, text), with the value of the first indented `key:` of each file replaced; indent, comment and all else stay."""
    if not re.fullmatch(KEY, key):
        raise ValueError("a key is made of letters, digits, _ and -")
    if value not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    pattern = rf"^(\s+{key}:\s*)([^\s#]*)(.*)$"
    found = lines.filter(F.col("text").rlike(pattern))
    if plan is not None:
        first = found.groupBy(plan).agg(F.min("line").alias("_at"))
        return lines.join(first, plan, "left").select(plan, "line", F.when(F.col("line") == F.col("_at"), F.regexp_replace("text", pattern, f"$1{value}$3")).otherwise(F.col("text")).alias("text"))
    first = found.agg(F.min("line").alias("_at"))  # one row
    return lines.join(F.broadcast(first)).select("line", F.when(F.col("line") == F.col("_at"), F.regexp_replace("text", pattern, f"$1{value}$3")).otherwise(F.col("text")).alias("text"))
