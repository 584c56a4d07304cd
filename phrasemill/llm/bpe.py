"""Byte-level BPE encoding and decoding (operator 1).

Texts are cut at white space into chunks, which the pre-token pattern never crosses; distinct chunks are split by the
pattern once, and the distinct pre-tokens are merged together in padded numpy matrices: one row a pre-token, rows
of about one length in one matrix. Each round every row merges its leftmost pair of minimum rank; pairs are found
in an open-addressing hash table, finished rows leave the matrix and the others move up.

Results: null and empty texts have no tokens; equal texts have equal ids; a pre-token longer than LONG bytes is merged
with a heap in O(n log n), by the same rule, so one very long run of letters costs no quadratic time. Only the id
and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkStore, Numbers, ranges
from .common import map_texts

NONE = np.int32(2**31 - 1)
#: Bytes from which a pre-token is merged with a heap.
LONG = 256
#: Cells of one matrix at most.
CELLS = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks as arrays, small enough to go with each task (a few MB, fixed by the vocabulary file)."""

    pattern: str
    tokens: tuple[bytes, ...]
    keys: np.ndarray
    values: np.ndarray
    shift: int

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        tokens = [b""] * (max(ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            tokens[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(8, (4 * len(pairs)).bit_length())
        keys, values, mask = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), (1 << bits) - 1
        for key, rank in pairs.items():
            slot = (key * int(MIX) & (2**64 - 1)) >> (64 - bits)
            while keys[slot] >= 0:
                slot = slot + 1 & mask
            keys[slot], values[slot] = key, rank
        return cls(pattern, tuple(tokens), keys, values, 64 - bits)

    @classmethod
    def from_tiktoken(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls.from_ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


class Codec(ChunkStore):
    """Encodes and decodes in one Python process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.pattern = regex.compile(vocabulary.pattern)
        self.ranks = {t: i for i, t in enumerate(vocabulary.tokens) if t}
        self.bytes_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.token_size, self.token_start = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        super().__init__()

    # -- merging ------------------------------------------------------------------------------------------------

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or NONE; -1 on either side is padding."""
        out = np.full(left.shape, NONE, np.int32).reshape(-1)
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).reshape(-1)
        todo = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        key = key[todo]
        with np.errstate(over="ignore"):
            slot = (key.view(np.uint64) * MIX >> np.uint64(self.v.shift)).astype(np.int64)
        while len(todo):
            found = self.v.keys[slot]
            hit = found == key
            out[todo[hit]] = self.v.values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, key, slot = todo[on], key[on], slot[on] + 1 & len(self.v.keys) - 1
        return out.reshape(left.shape)

    def merge_rows(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """BPE of each row of byte ids, which ends with -1 as padding: parts of (rows, ids of these one after another, ids of each)."""
        out = []
        index, ids = np.arange(len(rows)), rows
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        while len(index):
            row, width = np.arange(len(index)), ids.shape[1] - 1
            if width:
                at = rank.argmin(axis=1)
                best = rank[row, at]
                over = best == NONE
            else:
                over = np.ones(len(index), bool)
            if over.any():
                done = ids[over]
                real = done >= 0
                out.append((index[over], done[real], real.sum(axis=1)))
                if over.all():
                    break
                going = ~over
                index, ids, rank, at, best = index[going], ids[going], rank[going], at[going], best[going]
                row = row[: len(index)]
            # Column at+1 of ids goes, and column at of rank; what is right of it moves up.
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(-1, width)
            ids[row, at] = best
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(-1, width - 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            r, c = np.concatenate([row[left], row[right]]), np.concatenate([at[left] - 1, at[right]])
            rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same rule for one long pre-token: a heap of (rank, position) over a linked list."""
        ids = self.bytes_id[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        heap = [(r, i) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or get(part[i] + part[j]) != r:
                continue
            part[i], part[j], ids[i], after[i] = part[i] + part[j], None, r, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := get(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (k := before[i]) >= 0 and (q := get(part[k] + part[i])) is not None:
                heapq.heappush(heap, (q, k))
        return np.array([x for x, p in zip(ids, part, strict=True) if p is not None], np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, ids of each word)."""
        get = self.ranks.get
        whole = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        known = np.flatnonzero(whole >= 0)
        parts = [(known, whole[known].astype(np.int32), np.ones(len(known), np.int64))]
        for i in np.flatnonzero((whole < 0) & (size > LONG)).tolist():
            ids = self.merge_long(words[i])
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        width = np.where(size <= 24, size, -(-size // 16) * 16)
        width[(whole >= 0) | (size > LONG)] = 0
        for w in np.unique(width[width > 0]).tolist():
            members = np.flatnonzero(width == w)
            for first in range(0, len(members), max(1, CELLS // w)):
                some = members[first : first + max(1, CELLS // w)]
                rows = np.full((len(some), w), -1, np.int32)
                rows[np.arange(w) < size[some, None]] = self.bytes_id[np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)]
                parts += [(some[i], ids, n) for i, ids, n in self.merge_rows(rows)]
        at, ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        count = np.zeros(len(words), np.int64)
        count[at] = n
        out = np.empty(len(ids), np.int32)
        out[ranges((np.cumsum(count) - count)[at], n)] = ids
        return out, count

    # -- texts --------------------------------------------------------------------------------------------------

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers = Numbers()
        split = [self.pattern.findall(s) for s in strings]
        slots = numbers.of((w for p in split for w in p), sum(map(len, split)))
        flat, count = self.encode_words([w.encode() for w in numbers.take()])
        size = count[slots]
        ids = flat[ranges((np.cumsum(count) - count)[slots], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(p) for p in split])])]
        return ids, np.diff(ends), self.token_size[ids]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all sequences one after another, their edges); ids outside the vocabulary raise IndexError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_size)):
            raise IndexError("a token id is outside the vocabulary")
        size = self.token_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.token_bytes[ranges(self.token_start[ids], size)], ends[edges]


def _lists(edges: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def _codec(shared):
    """One codec a worker process: a later task of the same vocabulary finds the chunks known."""
    key = shared.value.tokens[-1], len(shared.value.tokens), shared.value.pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


_CODECS: dict = {}


#: Gets ids, their edges, decoded bytes and their edges for a slice of texts; returns columns.
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, finish: tuple[Finish, str] | None = None) -> DataFrame:
    """(id_col, ids array<int>), and with `decoded` also decoded binary: the ids turned back into bytes.

    With `finish`, a function and the schema of its columns, these follow id_col instead: what is made of ids and decoded bytes in
    the worker need not pass through the JVM.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    rest = finish[1] if finish else "ids array<int>" + ", decoded binary" * decoded
    names = ["_id", *(c.strip().split()[0] for c in rest.split(","))]

    def make():
        codec = _codec(shared)

        def work(keys, texts):
            ids, edges = codec.encode(texts)
            if finish:
                columns = finish[0](ids, edges, *codec.decode(ids, edges))
            else:
                columns = [_lists(edges, pa.array(ids)), *([_binaries(*codec.decode(ids, edges))] if decoded else [])]
            return pa.RecordBatch.from_arrays([keys, *columns], names)

        return work

    return map_texts(df, id_col, text_col, f"_id {kind}, {rest}", make).withColumnRenamed("_id", id_col)


def count_tokens(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(id_col, n_tokens bigint) of each whole text; null counts as empty. With `keep` a worker keeps the codec for later tasks, else its memory is free again after each."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        codec = _codec(shared) if keep else Codec(shared.value)
        return lambda keys, texts: pa.RecordBatch.from_arrays([keys, pa.array(np.diff(codec.encode(texts)[1]))], ["_id", "n_tokens"])

    return map_texts(df, id_col, text_col, f"_id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint", make).withColumnRenamed("_id", id_col)


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary): the bytes of each sequence; null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [x or [] for x in part.column(1).to_pylist()]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                ids = np.array([i for x in rows for i in x], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), _binaries(*codec.decode(ids, edges))], ["_id", "decoded"])

    return df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {kind}, decoded binary").withColumnRenamed("_id", id_col)
