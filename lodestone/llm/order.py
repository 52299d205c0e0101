"""Token sequences in training order, written as binary shards of fixed stride.

Each text becomes its token ids and an end mark, cut into sequences of LENGTH ids, the last one filled
with end marks. Sequences are numbered 0 to N - 1 by partition of the table and place in it; a keyed
Feistel network over the next even number of bits, walked until it lands below N, permutes the numbers
into slots. Slots k * PER_SHARD to (k + 1) * PER_SHARD - 1 are shard k: one partition, in order of slot,
one file of records of the same size. So slot s stands at (s mod PER_SHARD) * stride in its shard, a
reader goes through the order sequentially, and resumes anywhere with one seek.

Texts are tokenised twice, once to count and once to write, so that neither texts nor ids are stored in
between; the second pass fails if a partition does not hold the sequences that the first one counted.
Per partition one number comes to the driver. Equal slots cannot occur, so there are no ties. df must be a plain read of a table (write the
result of other operators first). Files are written under a name of their attempt and renamed, so a
task that runs again replaces its shard by the same bytes.

Ids are those of op8, special tokens in a text included; the end mark is the first special token. Null and
empty texts are a single end mark; very long ones are as many sequences as they need. Repeated rows are written as often as they occur. Columns
other than the id and the text are not read. An empty table has no shards.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import CUT, groups, shipped, tokenizer_path
from lodestone.llm.common import FORGET, shared_dir, table, tidy, written

LENGTH, PER_SHARD, KEY, ROUNDS = 256, 1 << 15, 20240607, 6
#: The special tokens of the vocabulary, numbered from the first id that its ranks leave free.
SPECIAL = ("<|endoftext|>",)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    if back:
        for k in reversed(keys):
            left, right = right ^ (_mix(left, k) & mask), left
    else:
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << np.uint64(half)) | right


def permuted(numbers: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0 to n - 1 (its inverse, if back)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)]
    out = _network(np.asarray(numbers, np.uint64), half, keys, back)
    while (far := out >= n).any():
        out[far] = _network(out[far], half, keys, back)
    return out.astype(np.int64)


class Ids:
    """Ids of texts by a file of ranks, special tokens as op8 knows them included."""

    def __init__(self, data: bytes, special: tuple[str, ...]):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        #: The mark after each text: the first special token, or the first free id.
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.end + len(special) < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens={s: self.end + k for k, s in enumerate(special)})

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        own = self.encoding.encode_to_numpy
        return [own(t, allowed_special="all") for t in texts.to_pylist()]


loaded: dict[tuple, Ids] = {}
FORGET["order"] = loaded.clear


def ids_of(data: bytes, special: tuple[str, ...]) -> Ids:
    """Of a file's content, kept by the worker for the next task."""
    if (key := (hashlib.md5(data).digest(), special)) not in loaded:
        loaded.clear()
        loaded[key] = Ids(data, special)
    return loaded[key]


def cut(encoded: list[np.ndarray], length: int, end: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sequences of encoded texts as rows of `length` ids, filled with end marks; the text and number of ids of each, the mark counted once."""
    n = np.fromiter(map(len, encoded), np.int64, len(encoded))
    per = n // length + 1
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.full(int(first[-1]) * length, end, kind)
    at = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(at[-1]) - np.repeat(at[:-1], n)
    out[np.repeat(first[:-1] * length, n) + inside] = np.concatenate(encoded) if len(encoded) else 0
    owner = np.repeat(np.arange(len(n)), per)
    return out.reshape(-1, length), owner, np.minimum(length, n[owner] + 1 - (np.arange(len(owner)) - first[owner]) * length)


def stored(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_shards(df: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """Write the shards and index.json to the folder `out`; returns (slot, id_col, part, n_tokens, crc32, shard, place), a row per sequence."""
    narrow = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))

    sent = shipped(df.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = ids_of(sent.value, special), 0
        for _, texts in groups(batches):
            n += sum([len(x) // length + 1 for x in ids.encode(texts)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    counts = {r.part: r.n for r in narrow.mapInArrow(tidy(count, "order"), "part int, n bigint").collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = ids_of(sent.value, special), TaskContext.get().partitionId()
        at, stop = starts[part], starts[part] + counts[part]
        stride = length * ids.kind.itemsize
        for own, texts in groups(batches):
            made, owner, size = cut(ids.encode(texts), length, ids.end, ids.kind)
            n = len(made)
            slots = permuted(np.arange(at, at + n), total, key)
            at += n
            place = np.arange(n) - np.searchsorted(owner, owner)
            data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * stride).astype(np.int32)), pa.py_buffer(made)])
            yield pa.RecordBatch.from_arrays([pa.array(slots), own.take(pa.array(owner)), pa.array(place, pa.int32()), pa.array(size, pa.int32()), data], names=["slot", "id", "part", "n_tokens", "data"])
        if at != stop:
            raise RuntimeError("the table changed between counting and writing")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = stored(out)
        attempt, now, sink, place = TaskContext.get().taskAttemptId(), None, None, 0

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{root}/.{now}-{attempt}", f"{root}/shard-{now:06d}.bin")

        for batch in batches:
            shards, places, sums = [], [], []
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if slot // per_shard != now:
                    close()
                    now, place = slot // per_shard, 0
                    sink = store.open_output_stream(f"{root}/.{now}-{attempt}")
                if slot % per_shard != place:
                    raise RuntimeError("a shard has a gap")
                sink.write(data)
                shards.append(now), places.append(place), sums.append(zlib.crc32(data))
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64()), pa.array(shards, pa.int32()), pa.array(places, pa.int32())], names=["slot", "id", "part", "n_tokens", "crc32", "shard", "place"])
        close()

    here = ids_of(sent.value, special)
    store, root = stored(out)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "per_shard": per_shard, "dtype": here.kind.str, "end": here.end, "key": key}).encode())
    made = narrow.mapInArrow(tidy(sequences, "order"), "slot bigint, id bigint, part int, n_tokens int, data binary").withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    # The slots are dense, so shards are equal ranges and their bounds need no sampling.
    ranged = made.repartitionById(max(1, -(-total // per_shard)), F.col("shard")).drop("shard").sortWithinPartitions("slot")
    rows = written(ranged.mapInArrow(tidy(save), "slot bigint, id bigint, part int, n_tokens int, crc32 bigint, shard int, place int"))
    for left in store.get_file_info(pafs.FileSelector(root)):
        if left.base_name.startswith("."):  # of attempts that failed
            store.delete_file(left.path)
    return rows.withColumnRenamed("id", id_col)


def read_slots(uri: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots start to stop - 1, in order; each shard is read from its first wanted record on."""
    store, root = stored(uri)
    with store.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    stride = index["length"] * np.dtype(index["dtype"]).itemsize
    stop = index["sequences"] if stop is None else min(stop, index["sequences"])
    while start < stop:
        shard, place = divmod(start, index["per_shard"])
        upto = min(stop, (shard + 1) * index["per_shard"])
        with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(place * stride)
            for _ in range(start, upto):
                yield np.frombuffer(f.read(stride), index["dtype"])
        start = upto


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), shared_dir(spark))
