"""Near-duplicate documents: banded MinHash, candidates checked on odd sketches, links confirmed on full sets.

Texts whose words are equal are one class, found by a 128-bit hash of the words and pre-aggregated; what
follows sees one document per class. Each has SAMPLES MinHash values of its shingles. BANDS groups of
ROWS of them give bucket keys; buckets with the same members are one. All the values are folded into an
odd sketch: every (position, value) flips one of BITS bits, so the bits in which two sketches differ count
the differing values modulo collisions, and their number estimates a high similarity far better than the
shared buckets do. A second parity bitmap, of WHOLE bits, folds the whole set: two sets differ in at least as
many shingles as their bitmaps do in bits, which refutes a pair for certain. Pairs whose sketches may reach the
threshold and whose bitmaps do not refute them are candidates.

Candidates are compared in rounds; a bucket is cut into blocks of about BLOCK members, each named pair is
confirmed on the words of both texts, and only confirmed links unite. The first round takes every document in the
largest of its buckets alone, compares each block with itself and with the least of the bucket, and names a
least spanning forest of the block's candidates: fewer pairs than members. The next round takes the buckets that still
have members of several components, compares every pair of blocks, and every member outside the block's largest
component names its nearest candidates of other components, MOST of them at most. While a member has more
than that, its bucket goes into another round that names WIDER times as many. So no pair of candidates in
different components is left unchecked, a large group is joined by a forest and never emits all its pairs, and no text
and no set is copied per block: blocks hold ids, sizes and sketches.

With bands of 5 in 25, a pair at the threshold of 0.85 shares no bucket once in two million. A sketch
of 512 values errs by about 0.018 (standard deviation) at 0.85; candidates are pairs down to four of those
below it.

Null, empty and blank texts have no shingles and are linked with nothing. A text of any length is read whole.
Repeated rows are copies; rows that share an id but not the text are one node with the links of all of them.
Equally near candidates are named by id. One row per input row comes back. Other columns are not read, so
names cannot clash; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import FORGET, Scratch, bitmap, dropped, free, perhaps_in, runs, table, tidy, written
from lodestone.llm.components import components

WORDS, PERCENT = 5, 85
SAMPLES, BANDS, ROWS, BITS, WHOLE, BLOCK, MOST, WIDER = 512, 25, 5, 1024, 2048, 400, 4, 8
#: Standard error of a sketch's estimate at 0.85; candidates may lie four of them below the threshold.
ERROR = 0.018
_rng = np.random.default_rng(20240607)
FACTOR = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFT = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
WORD_FACTOR = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
#: Hashes of words that a worker remembers.
KNOWN = 100_000
known: dict[bytes, int] = {}
FORGET["neardup"] = known.clear


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower-casing and ASCII white space, as bytes do them."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the runs of WORDS words; of all words if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN:
        known.clear()
    codes = [known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
    a, k = np.array(codes, dtype=np.uint64), min(n, WORDS)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += a[i : n - k + 1 + i] * WORD_FACTOR[i]
    return np.unique(mixed(out))


def samples(items: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        part = np.multiply(FACTOR[:, None], x[None, at : at + 256])
        part += SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    at = mixed(least.astype(np.uint64) + PLACE) >> np.uint64(54)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def whole_bitmap(items: np.ndarray) -> bytes:
    at = items & np.uint64(WHOLE - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=WHOLE) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key + rows[:, i])
    return key.view(np.int64)


def differing(similarity: float) -> int:
    """Differing sketch bits expected at a similarity."""
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity))))


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, n, keys, sketch); of empty texts h1 to sketch are null but n."""
    narrow = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, n, keys, sketches = [], [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                items = shingles(words)
                n.append(len(items))
                if not words:
                    h1.append(None), h2.append(None), keys.append(None), sketches.append(None)
                    continue
                digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                h1.append((digest >> 64) - (1 << 63)), h2.append((digest & (1 << 64) - 1) - (1 << 63))
                least = samples(items)
                keys.append(band_keys(least)), sketches.append(odd_sketch(least) + whole_bitmap(items))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "h1", "h2", "n", "keys", "sketch"])

    return narrow.mapInArrow(tidy(run, "neardup"), "id bigint, h1 bigint, h2 bigint, n bigint, keys array<bigint>, sketch binary")


def distances(n: np.ndarray, component: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Differing sketch bits of rows of left and right, and the most that a candidate may have; other pairs have more."""
    near = differing(max(0.0, percent / 100 - 4 * ERROR))
    out, split = np.empty((len(left), len(right)), np.int32), BITS // 64
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        z = np.bitwise_count(sketch[x][:, None, :split] ^ sketch[right][None, :, :split]).sum(axis=2, dtype=np.int32)
        apart = np.bitwise_count(sketch[x][:, None, split:] ^ sketch[right][None, :, split:]).sum(axis=2, dtype=np.int64)
        sizes = n[x][:, None] + n[right][None]
        z[(apart * (100 + percent) > sizes * (100 - percent)) | (np.abs(n[x][:, None] - n[right][None]) * (100 + percent) > sizes * (100 - percent)) | (component[x][:, None] == component[right][None])] = near + 1
        out[at : at + 64] = z
    return out, near


def forest(z: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """A least spanning forest of the pairs with distances up to `near`, grown from row 0 on."""
    m = len(z)
    best, parent, out = np.full(m, near + 1, z.dtype), np.zeros(m, np.int64), []
    waiting, now = np.ones(m, bool), 0
    for _ in range(m - 1):
        waiting[now] = False
        closer = waiting & (z[now] < best)
        best[closer], parent[closer] = z[now][closer], now
        now = int(np.where(waiting, best, near + 2).argmin())
        if best[now] <= near:
            out.append((parent[now], now))
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def nearest(z: np.ndarray, near: int, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row and column of each row's `most` nearest candidates, by distance and then id; whether some row has more."""
    good = z <= near
    crowded = np.flatnonzero(good.sum(axis=1) > most)
    if len(crowded):
        order = np.lexsort((np.broadcast_to(ids, (len(crowded), len(ids))), z[crowded]), axis=1)[:, :most]
        good[crowded] = False
        good[crowded[:, None], order] = True
    return *np.nonzero(good), bool(len(crowded))


def candidates(grouped: DataFrame, most: int | None, percent: int) -> DataFrame:
    """grouped: (key, i, j, side, id, n, component, sketch) in the order of key, i, j within each partition.

    Pairs (a, b) with a below b: a forest of each block if `most` is None, else the nearest ones; and for each key of
    which a row has more than `most` candidates a row with that key alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "i", "j"]):
            m = rows.num_rows
            if m < 2:
                continue
            ids, n, component, side = (rows.column(c).to_numpy() for c in ("id", "n", "component", "side"))
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(m, (BITS + WHOLE) // 64)
            key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
            every, more, named = np.arange(m), False, []
            if most is None:
                a, b = forest(*distances(n, component, sketch, every, every, percent))
                named.append((ids[a], ids[b]))
            else:
                kinds, of = np.unique(component, return_inverse=True)
                if len(kinds) == 1:
                    continue
                speaks = of != np.bincount(of).argmax()
                for left, right in ((every, every),) if i == j else ((every[side == 0], every[side == 1]), (every[side == 1], every[side == 0])):
                    left = left[speaks[left]]
                    z, near = distances(n, component, sketch, left, right, percent)
                    a, b, cut = nearest(z, near, ids[right], most)
                    named.append((ids[left[a]], ids[right[b]]))
                    more |= cut
            a, b = (np.concatenate(x) for x in zip(*named, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            k = pairs.shape[1]
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(k, pa.int64())], names=["a", "b", "key"])
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64())], names=["a", "b", "key"])

    return grouped.mapInArrow(tidy(run, "neardup"), "a bigint, b bigint, key bigint")


def whole_sets(words: list[bytes]) -> set:
    """The distinct shingles themselves."""
    return set(zip(*[words[k:] for k in range(WORDS)])) if len(words) >= WORDS else {tuple(words)} if words else set()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) reach the threshold, by the words themselves."""
    scratch = Scratch()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    asked = perhaps_in(texts, bitmap(ends, "id", scratch), F.col("id"), "perhaps_asked").filter("perhaps_asked").select("id", "text")
    # Texts that no pair asks for stay where they are. One plan at every size, so nothing is broadcast when it is small.
    asked = scratch(asked)
    one = scratch(pairs.join(asked.select(F.col("id").alias("a"), F.col("text").alias("x")).hint("merge"), "a"))
    both = one.join(asked.select(F.col("id").alias("b"), F.col("text").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, mine = None, set()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                if (y := y.as_py()) != text:  # rows come sorted by b
                    text, mine = y, whole_sets(words_of(y))
                other = whole_sets(words_of(x.as_py()))
                common = len(mine & other)
                keep.append(common > 0 and 100 * common >= percent * (len(mine) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = written(both.mapInArrow(tidy(run, "neardup"), "a bigint, b bigint").distinct())
    scratch.clear()
    return found


def blocked(members: DataFrame, first: bool) -> DataFrame:
    """Deal members (key, c, least, id, n, component, sketch) into blocks (key, i, j, side, ...): each with itself and the bucket's least member, or all pairs."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if first:
        dealt = dealt.withColumn("i", F.explode(F.when(F.col("id") == F.col("least"), every).otherwise(F.array("block")))).withColumn("j", F.col("i")).withColumn("side", F.lit(0))
    else:
        dealt = dealt.withColumn("other", F.explode(every)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    order = ["key", "i", "j"]
    return dealt.select(*order, "side", "id", "n", "component", "sketch").repartition(*order).sortWithinPartitions(*order)


def links_of(heads: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """From heads (id, n, keys, sketch) and texts (id, text): (node, component) of all that have a link."""
    scratch = Scratch()
    banded = heads.select("id", F.explode("keys").alias("key"))
    twice = scratch(banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    held = scratch(perhaps_in(banded, bitmap(twice, "key", scratch), F.col("key"), "perhaps_shared").filter("perhaps_shared").select("key", "id"))
    # One bucket of those with the same members, told by 128 bits.
    met = held.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("c > 1")
    shared = scratch(met.groupBy("c", "least", "x", "y").agg(F.min("key").alias("key")).select("key", "c", "least"))
    members = scratch(held.join(shared.hint("merge"), "key"))
    narrow = heads.select("id", "n", "sketch")
    own = members.groupBy("id").agg(F.max(F.struct("c", "key")).alias("own")).select("id", F.col("own.key").alias("key"))
    own = scratch(own)
    met = own.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("least")).filter("c > 1")
    here = own.join(met.hint("merge"), "key").join(narrow.hint("merge"), "id").withColumn("component", F.col("id"))
    links = confirmed(scratch(candidates(blocked(here, True), None, percent).select("a", "b").distinct()), texts, percent)
    open_, found, most = members, scratch(components(links)), MOST
    while True:
        labelled = scratch(open_.join(found.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        several = scratch(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key"))
        if several.isEmpty():
            break
        now = labelled.join(several.hint("merge"), "key", "left_semi").join(narrow.hint("merge"), "id")
        out = scratch(candidates(blocked(now, False), most, percent))
        named = scratch(out.filter("a is not null").select("a", "b").distinct())
        if named.isEmpty():
            break
        links = scratch(links.unionByName(confirmed(named, texts, percent)))
        found = scratch(components(links))
        cut = scratch(out.filter("key is not null").select("key").distinct())
        if cut.isEmpty():
            break
        open_ = scratch(members.join(cut.hint("merge"), "key", "left_semi"))
        most *= WIDER
    result = written(found)
    scratch.clear()
    return result


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per input row: id_col, n_shingles, component_id, kept. Ids are numbers."""
    every = written(sketched(df, id_col, text_col))
    classes = written(every.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "rep")
    mine = every.filter("id is not null and h1 is not null").join(reps.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("id") == F.col("rep")))
    heads = written(mine.select("id", "h1", "h2", "n", "keys", "sketch").dropDuplicates(["id", "h1", "h2"]).drop("h1", "h2"))
    texts = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))
    found = links_of(heads, texts, percent)
    dropped(heads)
    named = every.select("id", "h1", "h2", "n").join(classes.hint("merge"), ["h1", "h2"], "left").select("id", "n", F.coalesce("rep", "id").alias("node"))
    out = named.join(found.hint("merge"), "node", "left").select("id", "n", F.coalesce("component", "node").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """df with one row of each group of near copies: the one with the smallest id; of rows that share it, that with the least text. Rows without id stay.

    Only rows that may go are moved, as far as a bitmap of fixed size can tell them.
    """
    found = written(near_duplicates(df, id_col, text_col, percent).select(F.col(id_col).alias("id"), "kept").filter("id is not null"))
    key, flag, row = (free(df, c) for c in ("id_of_copies", "perhaps_copy", "row"))
    counted = written(found.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 or not kept"))
    marked = perhaps_in(df, bitmap(counted, "id"), df[id_col].cast("bigint"), flag)
    moved = F.col(flag) & F.col(id_col).isNotNull()
    copies = counted.filter("not kept").select(F.col("id").alias(key)).hint("merge")
    left = marked.filter(moved).drop(flag)
    left = left.join(copies, left[id_col].cast("bigint") == copies[key], "left_anti")
    one = left.groupBy(F.col(id_col).alias(key)).agg(F.min_by(F.struct(*[left[c] for c in df.columns]), F.coalesce(left[text_col].cast("string"), F.lit(""))).alias(row))
    return marked.filter(~moved).select(*df.columns).unionByName(one.select(*[F.col(row)[c].alias(c) for c in df.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
