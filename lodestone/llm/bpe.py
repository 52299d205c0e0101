"""Byte-level BPE by prefix sharing over a trie of the distinct words.

The encoding of a byte string is fixed by a chain of *last tokens*: the last token of a prefix ends
a valid encoding exactly if it cannot merge across its border with the last token of what stands
before it. Those states depend on the prefix alone, so the distinct words of a batch are put in a
trie (kept as the sorted word list: the common prefix of two neighbours is the branch they share)
and a depth-first walk computes the states of each shared prefix once.

Texts are taken in groups of about GROUP bytes. Arrow cuts them before single spaces and numbers
the distinct pieces; only those come to Python, and those not remembered go through the trie. Token ids,
the decimal ids and the decoded bytes of all texts are then gathered from the distinct pieces by number.
Texts in which white space meets a space, or that hold a special token, are cut by the pattern instead.

Texts are whole, of any length; a null text counts as empty and has no tokens. Words are remembered in two
generations of 2 * `CACHE` at most: those used since the last change of generation stay, others go. Columns other
than the id and the text are not carried, so their names cannot clash.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import FORGET, table, tidy

#: Words after which a generation ends, and pairs of tokens that a worker remembers.
CACHE = 100_000
#: Tokens whose merge trees' edges a worker remembers, for each side.
SPINES = 8_000
#: Bytes of a tokenizer file at most: it is broadcast.
FILE_MOST = 1 << 26
#: Longer words are not remembered.
LONG = 256
#: Bytes of texts taken at a time.
GROUP = 10_000_000
#: Texts of a batch that is given back.
OUT = 2000
FIELDS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
#: Fixed values of byte-level BPE: how a text is cut before merging, where the file does not name its own pattern.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of any alphabet, for RE2; MARK stands before a piece while Arrow cuts.
BLANK, MARK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", "\x1f"
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of the content of one tokenizer file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ids = {as_bytes(s): i for s, i in vocab.items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lengths = {i: len(b) for i, b in self.bytes.items()}
        size = max(self.bytes) + 1
        self.octets = pa.array([self.bytes.get(i, b"") for i in range(size)], pa.binary())
        self.digits = pa.array([b"%d," % i for i in range(size)], pa.binary())
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(whole, (*pair, r))
        self.longest = max(map(len, self.ids))
        self.cut = regex.compile(own_pattern(spec) or CUT).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.odd = "|".join([f"{BLANK} ", f" {BLANK}", MARK, *map(regex.escape, self.special)])
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.firm: dict[int, bool] = {}
        #: Only tokens whose own bytes encode to them can end a prefix.
        self.firm_ids = {b: i for b, i in self.ids.items() if self.whole(i)}.get
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens on one edge of a token's merge tree, single byte first, and the rank that ends each."""
        known = self.spines[right]
        if (out := known.get(token)) is None:
            chain, end, node = [], NEVER, token
            while True:
                chain.append((node, end))
                if (p := self.parts.get(node)) is None:
                    break
                node, end = p[right], p[2]
            if len(known) >= SPINES:
                known.clear()
            out = known[token] = chain[::-1]
        return out

    def crossing(self, a: int, b: int, free: int = NEVER) -> bool:
        """Whether some merge before rank `free` joins the end of a with the start of b."""
        left, right, rank = self.spine(a, True), self.spine(b, False), self.rank
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            r = rank.get((x, y))
            if r is not None and r < x_end and r <= y_end and r < free:
                return True
            if x_end == y_end == NEVER:
                return False
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it alone."""
        if (known := self.firm.get(token)) is None:
            p = self.parts.get(token)
            known = self.firm[token] = p is None or (self.whole(p[0]) and self.whole(p[1]) and not self.crossing(p[0], p[1], p[2]))
        return known

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()  # a pair is one dictionary step per border to find again
            known = self.pairs[key] = not self.crossing(a, b)
        return known

    def extend(self, word: bytes, last: list[int], start: int) -> None:
        """Set last[i], the last token of word[:i], for each i from start on."""
        ids, longest, pairs, fits = self.firm_ids, self.longest, self.pairs, self.fits
        grown = self.lengths[last[start - 1]] + 1 if start > 1 else 1
        for i in range(start, len(word) + 1):
            # Most often the last token grows by this byte or the byte stands alone; just one end fits, so any order finds it.
            j = i - grown
            if (token := ids(word[j:i])) is not None:
                if j == 0:
                    last.append(token)
                    grown = i + 1
                    continue
                if (fit := pairs.get((last[j], token))) or fit is None and fits(last[j], token):
                    last.append(token)
                    grown += 1
                    continue
            token = ids(word[i - 1 : i])
            if not ((fit := pairs.get((last[i - 1], token))) or fit is None and fits(last[i - 1], token)):
                for j in range(max(0, i - longest), i - 1):
                    if (token := ids(word[j:i])) is not None and (j == 0 or fits(last[j], token)):
                        break
                else:
                    raise ValueError("no token ends this prefix")
                last.append(token)
                grown = i - j + 1
            else:
                last.append(token)
                grown = 2

    def tokens(self, word: bytes, last: list[int]) -> list[int]:
        out, i, lengths = [], len(word), self.lengths
        while i:
            out.append(t := last[i])
            i -= lengths[t]
        return out[::-1]

    def words(self, distinct: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Depth-first over the trie of the words: a word starts from the states of the prefix it shares."""
        out: dict[bytes, list[int]] = {}
        before, last = b"", [-1]
        for word in sorted(distinct):
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del last[k + 1 :]
            self.extend(word, last, k + 1)
            out[word] = self.tokens(word, last)
            before = word
        return out

    def recall(self, piece: str) -> tuple[int, ...] | None:
        """What is remembered of a piece, which thereby counts as used."""
        if (v := self.young.get(piece)) is None and (v := self.old.get(piece)) is not None:
            self.young[piece] = v
        return v

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Encode pieces of text, each cut into words first."""
        recall = self.recall
        cut = list(map(self.cut, pieces))
        known = dict.fromkeys(chain.from_iterable(cut))
        new = {}
        for w in known:
            if (v := recall(w)) is None:
                new[w.encode()] = w
            else:
                known[w] = v
        for data, ids in self.words(new.keys()).items():
            known[new[data]] = tuple(ids)
        if len(self.young) < 2 * CACHE:
            self.young |= {w: known[w] for w in new.values() if len(w) <= LONG}
        out = {c: known[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([known[w] for w in ws])) for c, ws in zip(pieces, cut, strict=True)}
        if len(self.young) < 2 * CACHE:
            self.young |= {c: v for c, v in out.items() if len(c) <= LONG}
        return out

    def encoded(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct pieces: remembered, or learnt now."""
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        out = list(map(self.recall, pieces))
        special = self.special
        missing = [k for k, v in enumerate(out) if v is None]
        new = self.learn([pieces[k] for k in missing if pieces[k] not in special])
        for k in missing:
            c = pieces[k]
            out[k] = new[c] if c in new else (special[c],)
        return out

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Pieces of texts that encode independently, and the first and last of each text's."""
        odd = pc.match_substring_regex(texts, self.odd)
        marked = pc.replace_substring(texts.filter(pc.invert(odd)), " ", MARK + " ")
        split = pc.split_pattern(marked, MARK)
        plain, ends = split.flatten(), split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
        is_odd = odd.to_numpy(zero_copy_only=False)
        more, counts = [], []
        for t in texts.filter(odd).to_pylist():
            before = len(more)
            if self.split_special is None:
                more += self.cut(t)
            else:
                for k, part in enumerate(self.split_special(t)):
                    more += [part] if k % 2 else self.cut(part)
            counts.append(len(more) - before)
        first, last = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        odd_ends = len(plain) + np.cumsum([0, *counts])
        first[~is_odd], last[~is_odd] = ends[:-1], ends[1:]
        first[is_odd], last[is_odd] = odd_ends[:-1], odd_ends[1:]
        return pa.concat_arrays([plain, pa.array(more, pa.string())]), first, last

    def encode(self, texts: pa.StringArray) -> Group:
        """The texts of a group, encoded; none may be null."""
        flat, first, last = self.pieces(texts)
        numbered = flat.dictionary_encode()
        was_on = gc.isenabled()
        gc.disable()  # a million tuples without cycles: walking them costs a third of the time
        try:
            found = self.encoded(numbered.dictionary.to_pylist())
        finally:
            if was_on:
                gc.enable()
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        return Group(self, ids, np.concatenate([[0], np.cumsum(size)]), numbered.indices, first, last)

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


class Group:
    """Encoded texts: the ids of the distinct pieces, and which pieces each text is made of."""

    def __init__(self, bpe: TrieBpe, ids: np.ndarray, starts: np.ndarray, order: pa.Int32Array, first: np.ndarray, last: np.ndarray):
        self.bpe, self.own, self.starts, self.order, self.first, self.last = bpe, ids, starts, order, first, last

    def bounds(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each text begins and ends, for a size of each distinct piece."""
        at = np.concatenate([[0], np.cumsum(size[self.order.to_numpy(zero_copy_only=False)])])
        return at[self.first], at[self.last]

    def counts(self) -> np.ndarray:
        lo, hi = self.bounds(np.diff(self.starts))
        return hi - lo

    def ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin and end."""
        whole = pa.LargeListArray.from_arrays(pa.array(self.starts, pa.int64()), pa.array(self.own, pa.int32())).take(self.order)
        return whole.flatten().to_numpy(zero_copy_only=False), *self.bounds(np.diff(self.starts))

    def gathered(self, of_token: pa.BinaryArray) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where those of each text begin and end."""
        tokens = of_token.cast(pa.large_binary()).take(pa.array(self.own, pa.int32()))
        size = np.diff(np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False))])[self.starts])
        at = np.concatenate([[0], np.cumsum(size)])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), tokens.buffers()[2] or pa.py_buffer(b"")])
        data = pieces.take(self.order).buffers()[2]
        return memoryview(data if data is not None else b""), *self.bounds(size)

    def decimal(self) -> Iterator[memoryview]:
        """For each text its decimal ids, joined by commas."""
        data, lo, hi = self.gathered(self.bpe.digits)
        return (data[a : max(a, b - 1)] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))

    def decoded(self) -> Iterator[str]:
        data, lo, hi = self.gathered(self.bpe.octets)
        return (str(data[a:b], "utf-8", "replace") for a, b in zip(lo.tolist(), hi.tolist(), strict=True))


def own_pattern(spec: dict) -> str | None:
    """The pattern that a tokenizer file names, if any."""
    steps = spec.get("pre_tokenizer") or {}
    for step in steps.get("pretokenizers", [steps]):
        if step.get("type") == "Split" and "Regex" in step.get("pattern", {}):
            return step["pattern"]["Regex"]
    return None


loaded: dict[bytes, TrieBpe] = {}
FORGET["bpe"] = loaded.clear


def from_content(data: bytes) -> TrieBpe:
    """The encoder of a file's content, kept by the worker for the next task."""
    if (key := hashlib.md5(data).digest()) not in loaded:
        loaded.clear()
        loaded[key] = TrieBpe(data)
    return loaded[key]


def encoder(path: str) -> TrieBpe:
    with open(path, "rb") as f:
        return from_content(f.read())


def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The content of a tokenizer file, for executors: a few MB, whatever the input. Files there need no copy of it."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > FILE_MOST:
        raise ValueError(f"{path} is no vocabulary file: {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(batches: Iterator[pa.RecordBatch], most: int = GROUP) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """The first column and the texts of the second, nulls as empty ones, by about `most` bytes of text whatever the batches."""
    held, size = [], 0

    def done() -> tuple[pa.Array, pa.StringArray]:
        ids, texts = zip(*held, strict=True)
        return pa.concat_arrays(ids), pa.concat_arrays(texts)

    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        lo, n = 0, len(texts)
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + most - size))))
            held.append((batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo)))
            size += int(at[hi] - at[lo])
            lo = hi
            if size >= most:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = ("n_tokens", "ids"), group_bytes: int = GROUP) -> DataFrame:
    """Encode each text and decode it again. Returns id_col and `fields`:

    n_tokens, ids (array<int>), decoded (the text of the ids), and SHA-256 digests of the ids joined
    by commas and of the decoded text. Larger groups share more work and need more memory in the worker. A repeated row gives a repeated result; an empty table none.
    """
    narrow = df.select(df[id_col], df[text_col].cast("string"))
    schema = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, " + ", ".join(f"{f} {FIELDS[f]}" for f in fields)
    sent = shipped(df.sparkSession, path)
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def column(group: Group, field: str) -> pa.Array:
        if field == "n_tokens":
            return pa.array(group.counts(), pa.int64())
        if field == "ids":
            ids, lo, hi = group.ids()
            n, at = hi - lo, np.concatenate([[0], np.cumsum(hi - lo)])
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids[np.repeat(lo - at[:-1], n) + np.arange(at[-1])], pa.int32()))
        if field == "ids_sha256":
            return pa.array(map(digest, group.decimal()), pa.string())
        if field == "decoded_sha256":
            return pa.array([digest(t.encode()) for t in group.decoded()], pa.string())
        return pa.array(group.decoded(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = from_content(sent.value)
        for ids, texts in groups(batches, group_bytes):
            group = bpe.encode(texts)
            pa.default_memory_pool().release_unused()
            made = pa.RecordBatch.from_arrays([ids, *(column(group, f) for f in fields)], names=[id_col, *fields])
            yield from (made.slice(lo, OUT) for lo in range(0, len(made), OUT))  # a group may hold very many short texts

    return narrow.mapInArrow(tidy(run, "bpe"), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), fields=("n_tokens", "ids_sha256", "decoded_sha256"))
