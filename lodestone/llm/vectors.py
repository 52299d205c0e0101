"""Near-duplicate vectors by sorted projection passes.

Vectors with the same label and length are compared. Equal ones are one class, pre-aggregated by a
hash of their bytes. In each pass every vector gets BITS signs of random projections, one
after the other, as a number; all passes are sorted at once by (pass, label, length, number), numbered
globally, and cut into blocks of BLOCK rows, each with the first WINDOW rows of the next one, so every
vector meets at least its WINDOW successors in each pass and a block never depends on a key's size.
Pairs in a block with cosine >= the threshold, in doubles, are links; a block passes on a spanning
forest of them. Components join the forests of all passes. Last, the links of each vector are counted
among all members of its component, in pairs of blocks of PART members, which copies a member once per
block of its component.

Projections are taken from the mean of all unit vectors (one vector per length comes to the driver), else
vectors that lean one way would share most signs. Against the mean, a pair at the threshold has the cosine
1 - (1 - threshold) / r, r the mean squared distance from the mean, and agrees in a sign with probability
p = 1 - angle / pi. The largest group of rows per label needs about b = log2(rows / (BLOCK / 2)) signs to be cut down to
blocks, so one pass brings such a pair together with probability p ** b at least; there are as many passes as
make the chance to miss it MISSED at most, so recall does not fall with the number of rows, and PASSES at least.

Null, zero, or empty vectors, those with null or non-finite components, and null labels are linked
with nothing. Rows with equal vectors and labels link each other, repeated rows included. Equal numbers are
ordered by id. Vectors have any length; an id with several vectors is one node with the links of all of them. Other
columns are not read, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import running, runs, table, tidy, written
from lodestone.llm.components import components

COSINE, PASSES, MISSED, BITS, BLOCK, WINDOW, PART, SEED = 0.98, 8, 0.001, 32, 448, 64, 128, 11


def unit(packed: pa.ChunkedArray) -> np.ndarray:
    """Packed doubles to rows of length 1."""
    raw = b"".join(packed.to_pylist())
    x = np.frombuffer(raw, np.float64).reshape(len(packed), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, v): v is null where a row can link with nothing."""
    x = df[vector_col].cast("array<double>")
    whole = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0) & df[label_col].isNotNull()
    good = F.coalesce(whole, F.lit(False))
    narrow = df.select(df[id_col].cast("bigint").alias("id"), df[label_col].cast("string").alias("label"), F.when(good, x).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if v is None else np.array(v, np.float64) + 0.0 for v in batch.column(2).to_pylist()]
            with np.errstate(over="ignore", under="ignore"):
                rows = [None if v is None else v / np.abs(v).max() for v in rows]  # no square overflows or vanishes
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0 if v is None else len(v) for v in rows], pa.int32()), pa.array([None if v is None else v.tobytes() for v in rows], pa.binary())], names=["id", "label", "dim", "v"])

    return narrow.mapInArrow(tidy(run), "id bigint, label string, dim int, v binary")


def centres(heads: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the mean of their unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                total, d = unit(part.column("v")).sum(axis=0), int(dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(total), pa.array(np.full(d, part.num_rows, np.int64))], names=["dim", "k", "total", "n"])

    found = heads.select("dim", "v").mapInArrow(tidy(run), "dim int, k int, total double, n bigint").groupBy("dim", "k").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    out = {r.dim: np.zeros(r.dim) for r in found}
    for r in found:
        out[r.dim][r.k] = r.mean
    return out


def passes_for(rows: int, cosine: float, mean: np.ndarray) -> int:
    """Passes after which a pair at the threshold is missed with probability MISSED at most."""
    spread = max(1e-9, 1 - float(mean @ mean))
    p = 1 - math.acos(max(-1.0, min(1.0, 1 - (1 - cosine) / spread))) / math.pi
    met = max(p, 0.5) ** max(0.0, math.log2(max(rows, 1) / (BLOCK / 2)))
    return PASSES if met >= 1 else max(PASSES, math.ceil(math.log(MISSED) / math.log1p(-met)))


def signed(heads: DataFrame, means: dict[int, np.ndarray], passes: int, bits: int) -> DataFrame:
    """(pass, sign, label, dim, id) for each vector and pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                d = int(dim)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, passes * bits))
                part = batch.filter(pa.array(dims == dim))
                n = part.num_rows
                sign = (((unit(part.column("v")) - means[d]) @ planes[d]) > 0).reshape(n, passes, bits) @ weights
                at = np.repeat(np.arange(n), passes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(passes, dtype=np.int32), n)), pa.array(sign.reshape(-1)), part.column("label").take(pa.array(at)), pa.array(np.full(n * passes, d, np.int32)), part.column("id").take(pa.array(at))],
                    names=["pass", "sign", "label", "dim", "id"],
                )

    return heads.mapInArrow(tidy(run), "pass int, sign bigint, label string, dim int, id bigint")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a, b) among n nodes make a spanning forest."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


def block_links(blocks: DataFrame, cosine: float) -> DataFrame:
    """blocks: (block, row_no, pass, label, dim, id, v), in the order of block and row_no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["block"]):
            labels, passes, dims = (rows.column(c).to_pylist() for c in ("label", "pass", "dim"))
            ids, v = rows.column("id").to_numpy(), rows.column("v")
            keys = list(zip(passes, labels, dims, strict=True))
            edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            a, b = [], []
            for lo, hi in zip(edges, edges[1:]):
                x = unit(v.slice(lo, hi - lo))
                i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
                own = forest(hi - lo, i, j)
                a += ids[lo + i[own]].tolist()
                b += ids[lo + j[own]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(tidy(run), "a bigint, b bigint")


def counted(parts: DataFrame, cosine: float) -> DataFrame:
    """parts: (component, i, j, side, id, c, v), in the order of component, i, j. For each id, rows of other classes that it links in the pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["component", "i", "j"]):
            x, c, ids = unit(rows.column("v")), rows.column("c").to_numpy(), rows.column("id")
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if rows.column("i")[0].as_py() != rows.column("j")[0].as_py():
                side = rows.column("side").to_numpy()
                linked &= side[:, None] != side[None]
            yield pa.RecordBatch.from_arrays([ids.combine_chunks(), pa.array(linked @ c, pa.int64())], names=["id", "n"])

    return parts.mapInArrow(tidy(run), "id bigint, n bigint")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, passes: int | None = None) -> DataFrame:
    """Per input row: id_col, n_links, component_id, kept. passes: as many as the rows ask for, if not given."""
    every = written(packed(df, id_col, vector_col, label_col).withColumn("h", F.when(F.col("v").isNotNull(), F.md5("v"))))
    classes = written(every.filter("h is not null").groupBy("label", "h").agg(F.min("id").alias("rep"), F.count("*").alias("c")))
    mine = every.join(classes.select(F.col("label").alias("l"), F.col("h").alias("hh"), "rep", "c"), (F.col("h") == F.col("hh")) & (F.col("label") == F.col("l")) & (F.col("id") == F.col("rep")))
    heads = written(mine.select("id", "label", "dim", "c", "v").dropDuplicates(["id", "label", "v"]))
    means = centres(heads)
    if passes is None:
        largest = heads.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
        passes = max([passes_for(r.n, cosine, means[r.dim]) for r in largest], default=PASSES)
    ordered = running(signed(heads, means, passes, BITS).withColumn("one", F.lit(1)), ["pass", "label", "dim", "sign", "id"], "one").drop("one", "before", "sign")
    block = F.floor(F.col("row_no") / BLOCK)
    both = F.when((F.col("row_no") % BLOCK < WINDOW) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = ordered.withColumn("block", F.explode(both)).join(heads.select("id", "label", "v"), ["id", "label"])
    links = block_links(dealt.select("block", "row_no", "pass", "label", "dim", "id", "v").repartition("block").sortWithinPartitions("block", "row_no"), cosine)
    found = written(components(links))
    # Components have the nodes with links; every member with its vector, dealt in pairs of blocks.
    members = written(found.join(heads, found.node == heads.id).select("component", "id", "label", "c", "v"))
    sizes = written(members.groupBy("component").agg(F.count("*").alias("size")))
    parts = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / PART).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "c", "v")
    order = ["component", "i", "j"]
    n = written(counted(parts.repartition(*order).sortWithinPartitions(*order), cosine).groupBy("id").agg(F.sum("n").alias("n")))
    per_class = written(
        classes.join(found, classes.rep == found.node, "left").join(n, classes.rep == n.id, "left")
        .select("label", "h", (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = every.select("id", "label", "h").join(per_class, ["label", "h"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id)
"""
