"""Line dedup by a fixed-depth tree of log templates.

A line's path in the tree is its number of tokens and its first DEPTH tokens; tokens with a digit or @
are fields and stand as <*>, unless most of the line is. Leaves whose lines recur in too few documents are done with: a bitmap of
fixed size, gathered from counts per leaf, keeps their lines from being shuffled at all. In each other
leaf, distinct lines are clustered, the most frequent first: a line that agrees with a template of the leaf
in SIMILAR of its positions is an instance of it, and the positions where they differ become fields; any
other line begins a template of its own. Templates found in MIN_DOCS documents (LONG_DOCS
if they have LONG tokens, SHORT_DOCS if fewer than SHORT) are recurring: their lines go everywhere but at the first place, by id and
line number. Documents with equal texts count once and are edited alike. A document that would lose more than
`max_loss` of its words to one other document, where their first places are, is compared with it: if the two
are near copies by the rule of op2 those lines stay, for document-level deduplication to judge, else they go; with
`max_loss` None nothing is compared and every recurring line goes.

All counting is pre-aggregated. The distinct lines of one leaf meet in one task, where an index of bands of
positions finds the templates to compare with; their copies do not.

Null texts have no lines and stay null. Lines with fewer than MIN_TOKENS tokens are never dropped.
Rows that share an id are edited alike; rows without id are counted but left as they are. All other
columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import operator
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bitmap, dropped, free, perhaps_in, runs, table, tidy, written
from lodestone.llm.neardup import shingles, words_of

DEPTH, SIMILAR, SHORT, SHORT_DOCS, MIN_DOCS, LONG, LONG_DOCS, MIN_TOKENS, MAX_LOSS = 3, 0.75, 10, 5, 3, 50, 2, 3, 0.5
FIELD_SIGNS = b"0123456789@"
FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def masked(line: bytes) -> list[bytes]:
    """Tokens, with fields as <*>; a line that is mostly fields has no template and stays as it is."""
    tokens = line.split()
    if len(line.translate(None, FIELD_SIGNS)) != len(line):
        found = FIELD.sub(b"<*>", line).split()
        if 2 * found.count(b"<*>") <= len(found):
            return found
    return tokens


def signed64(x: int) -> int:
    return x - (1 << 63)


def parsed(docs: DataFrame, texts: bool) -> DataFrame:
    """(id, pos, n, leaf, h1, h2, first) of each line with MIN_TOKENS or more; first: not seen before in its text. With the hash and words of its text and its tokens, if asked for."""
    names = ["id", "pos", "n", "leaf", "h1", "h2", "first", *(["doc", "words", "tokens"] if texts else [])]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    types = ["bigint", "int", "int", "bigint", "bigint", "bigint", "boolean", "bigint", "bigint", "string"]

    def rows(ident: int | None, text: str) -> Iterator[tuple]:
        seen = set()
        data = text.encode()
        doc, words = (signed64(xxhash.xxh3_64_intdigest(data)), len(data.split())) if texts else (0, 0)
        for pos, line in enumerate(data.split(b"\n")):
            tokens = masked(line)
            n = len(tokens)
            if n < MIN_TOKENS:
                continue
            whole = b" ".join(tokens)
            h = xxhash.xxh3_128_intdigest(whole)
            leaf = signed64(xxhash.xxh3_64_intdigest(b"%d " % n + b" ".join(tokens[:DEPTH])))
            out = (ident, pos, n, leaf, signed64(h >> 64), signed64(h & (1 << 64) - 1), h not in seen)
            seen.add(h)
            yield (*out, doc, words, whole.decode()) if texts else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [r for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t is not None for r in rows(i, t)]
                cols = zip(*found, strict=True) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return docs.mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def enough(docs: Column, n: Column) -> Column:
    return docs >= F.when(n >= LONG, LONG_DOCS).when(n >= SHORT, MIN_DOCS).otherwise(SHORT_DOCS)


def joined_clusters(kinds: list[list[str]]) -> list[int]:
    """For each of a leaf's distinct lines, most frequent first, the number of the line that began its cluster.

    A line joins the cluster whose template it agrees with most, in SIMILAR of its positions at least, and the
    positions where they differ become fields. A line with at most m differences equals the template in one of m + 1 bands.
    """
    n = len(kinds[0])
    most = int(n * (1 - SIMILAR))
    rest = range(min(DEPTH, n), n)
    bands = [rest[k :: most + 1] for k in range(most + 1)]
    index: dict[tuple, list[int]] = {}
    templates: dict[int, list[str | None]] = {}
    out = []
    for k, tokens in enumerate(kinds):
        keys = [(b, *[tokens[i] for i in band]) for b, band in enumerate(bands)]
        best, least = k, most + 1
        for c in sorted({c for key in keys for c in index.get(key, ())}):
            differ = sum(map(operator.ne, tokens, templates[c]))
            if differ < least:
                best, least = c, differ
        if best == k:
            templates[k] = list(tokens)
            for key in keys:
                index.setdefault(key, []).append(k)
        elif least:
            templates[best] = [t if t == own else None for t, own in zip(templates[best], tokens)]
        out.append(best)
    return out


def clustered(kinds: DataFrame) -> DataFrame:
    """From distinct lines (leaf, n, docs, h1, h2, tokens): (h1, h2, x, y), x and y the hash of the line that began the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["leaf"]):
            first = joined_clusters([t.split(" ") for t in group.column("tokens").to_pylist()])
            h1, h2 = group.column("h1").combine_chunks(), group.column("h2").combine_chunks()
            yield from pa.table([h1, h2, h1.take(pa.array(first)), h2.take(pa.array(first))], names=["h1", "h2", "x", "y"]).to_batches()

    return kinds.repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), "h1", "h2").mapInArrow(tidy(run), "h1 bigint, h2 bigint, x bigint, y bigint")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """From (id, text): (id, pos, n, words, by) of the lines to drop; words of the text, by the document of the first place."""
    leaves = parsed(docs, False).groupBy("leaf").agg(F.count_if("first").alias("docs"), F.max("n").alias("n")).filter(enough(F.col("docs"), F.col("n")))
    lines = perhaps_in(parsed(docs, True), bitmap(leaves, "leaf"), F.col("leaf"), "recurs").filter("recurs").drop("recurs")
    lines = written(lines)
    distinct = written(lines.groupBy("h1", "h2").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.count_if("first").alias("docs"), F.first("tokens").alias("tokens")))
    # Clusters, only where a leaf has lines that differ.
    mixed = written(distinct.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs"), F.first("n").alias("n")).filter((F.col("kinds") > 1) & enough(F.col("docs"), F.col("n"))).select("leaf"))
    clusters = written(clustered(distinct.join(mixed.hint("merge"), "leaf").select("leaf", "n", "docs", "h1", "h2", "tokens")))
    # Only lines that joined the cluster of another line get a new name; a bitmap tells most others without moving them.
    # Joins have one plan at every size: a small side is never broadcast just because the input is small.
    renamed = written(clusters.filter("x <> h1 or y <> h2"))
    here = lines.select("id", "pos", "n", "doc", "words", "h1", "h2")
    asked = perhaps_in(here, bitmap(renamed, "h1"), F.col("h1"), "perhaps_renamed")
    named = asked.filter("perhaps_renamed").join(renamed.hint("merge"), ["h1", "h2"], "left")
    columns = ("id", "pos", "n", "doc", "words")
    placed = written(named.select(*columns, F.coalesce("x", "h1").alias("x"), F.coalesce("y", "h2").alias("y")).unionByName(asked.filter("not perhaps_renamed").select(*columns, F.col("h1").alias("x"), F.col("h2").alias("y"))))
    # One row per text first, so that the second count only adds.
    per_doc = placed.groupBy("x", "y", "doc").agg(F.min(F.struct("id", "pos", "doc")).alias("kept"), F.first("n").alias("n"))
    recurring = written(per_doc.groupBy("x", "y").agg(F.count("*").alias("docs"), F.min("kept").alias("kept"), F.first("n").alias("n")).filter(enough(F.col("docs"), F.col("n"))).select("x", "y", "kept"))
    at_first = (F.col("pos") == F.col("kept.pos")) & (F.col("id").eqNullSafe(F.col("kept.id")) | (F.col("doc") == F.col("kept.doc")))
    seen = perhaps_in(placed.filter("id is not null"), bitmap(recurring, "x"), F.col("x"), "perhaps_recurring").filter("perhaps_recurring")
    drops = seen.join(recurring.hint("merge"), ["x", "y"]).filter(~at_first).select("id", "pos", "n", "words", F.col("kept.id").alias("by"))
    drops = written(drops)
    for used in (lines, distinct, mixed, clusters, renamed, placed, recurring):
        dropped(used)
    return drops


def near_copies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """From documents (id, text) and pairs (id, by): the pairs that op2 would link."""
    ends = pairs.select("id").unionByName(pairs.select(F.col("by").alias("id"))).distinct()
    texts = written(perhaps_in(docs, bitmap(ends, "id"), F.col("id"), "asked").filter("asked").drop("asked"))
    left = written(pairs.join(texts.hint("merge"), "id").withColumnRenamed("text", "one"))
    both = left.join(texts.select(F.col("id").alias("by"), F.col("text").alias("two")).hint("merge"), "by").select("id", "by", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (set(shingles(words_of(t.as_py())).tolist()) for t in (one, two))
                keep.append(bool(a) and 100 * len(a & b) >= 85 * len(a | b))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = written(both.mapInArrow(tidy(run), "id bigint, by bigint").distinct())
    for used in (texts, left):
        dropped(used)
    return found


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at these places (ascending, from 0): a mark per line, then one pass over both."""
    before = F.concat(F.array(F.lit(-1)), F.slice(places, F.lit(1), F.size(places) - 1))
    marks = F.split(F.array_join(F.zip_with(places, before, lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1"))), ""), "")
    return F.array_join(F.zip_with(F.split(text, "\n"), marks, lambda line, m: F.when(~F.coalesce(m == "1", F.lit(False)), line)), "\n")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float | None = MAX_LOSS) -> DataFrame:
    """All rows and columns of df, the text without its recurring lines, and n_dropped, n_dropped_words of each (with _ added if df has such columns)."""
    docs = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))
    drops = recurring_lines(docs)
    key, pos, flag, n_dropped, n_words = (free(df, c) for c in ("id_of_drops", "pos_of_drops", "perhaps_dropped", "n_dropped", "n_dropped_words"))
    lost = lambda found: F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    by = written(drops.groupBy("id", "by").agg(lost(F.collect_set(F.struct("pos", "n"))).alias("lost"), F.max("words").alias("words")))
    copies = near_copies(docs, written(by.filter(F.col("lost") > F.lit(max_loss) * F.col("words")).select("id", "by"))) if max_loss is not None else None
    gone = drops.select("id", "by", "pos", "n") if copies is None else drops.select("id", "by", "pos", "n").join(copies.hint("merge"), ["id", "by"], "left_anti")
    per_id = written(gone.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias(pos)))
    # Texts without drops are not shuffled, as far as a bitmap of fixed size can tell them.
    marked = perhaps_in(df, bitmap(per_id, key), df[id_col].cast("bigint"), flag)
    rest = marked.filter(~F.col(flag)).select(*df.columns, F.lit(0).alias(n_dropped), F.lit(0).cast("bigint").alias(n_words))
    found = marked.filter(flag).drop(flag)
    joined = found.join(per_id.hint("merge"), found[id_col].cast("bigint") == per_id[key], "left")
    edit = F.col(pos).isNotNull() & found[text_col].isNotNull()
    cols = [F.when(edit, without_lines(found[text_col], F.transform(pos, lambda p: p["pos"]))).otherwise(found[c]).alias(c) if c == text_col else found[c] for c in df.columns]
    dropped(drops), dropped(by)
    return rest.unionByName(joined.select(*cols, F.when(edit, F.size(pos)).otherwise(0).alias(n_dropped), F.when(edit, lost(F.col(pos))).otherwise(0).alias(n_words)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines_left"), "n_dropped", "n_dropped_words", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
