"""Texts as chunks that pre-tokens never cross, each distinct chunk encoded once.

A chunk is white space and what follows up to the next white space, or up to a mark after letters. A pre-token of the byte-level
pattern always ends there, so the ids of a text are those of its chunks, one after another. Chunks are found, hashed and
looked up in numpy, over all texts of a slice at once; what a worker has met is kept over slices and tasks. A chunk is known by two
independent 64-bit polynomial hashes with coefficients and bases drawn at random in each process; chunks over LONG bytes are encoded each time.
"""

from __future__ import annotations

import re

import numpy as np

#: Distinct chunks that a worker keeps; beyond that it forgets the rare ones.
KEEP = 250_000
#: Ids that a worker keeps.
KEEP_IDS = 4_000_000
#: Bytes of a chunk that is kept at most.
LONG = 256
#: Bytes that are hashed at once, chunks that are looked up at once.
BLOCK, CHUNKS = 1 << 18, 1 << 18
#: Unicode White_Space: the pattern's \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters; a pre-token of letters always ends before the marks that follow in CHUNK.
LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CHUNK = re.compile(rf"[{SPACE}]*+[{LETTER}]++(?=[,.;:!?])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

_of = lambda chars: np.isin(np.arange(256), list(chars))
WHITE, LETTERS, MARKS = _of(b"\t\n\x0b\x0c\r "), _of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _of(b",.;:!?")
# Drawn anew in each process, so that no text can be written whose chunks collide. Ids do not depend on them.
_DRAW = np.random.default_rng()
_RANDOM = _DRAW.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _DRAW.integers(1 << 61, 1 << 62, 2, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def _powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK + LONG, x, np.uint64))]) for x in (base, inverse))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] numbers), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white space beyond ASCII ends just before each position."""
    out = np.zeros(len(at), bool)
    some = np.flatnonzero(data[at - 1] >= 0x80)
    if len(some):
        i = at[some]
        a, b, c = data[i - 1], data[i - 2], np.where(i >= 3, data[i - 3], 0)
        general = (a >= 0x80) & (a <= 0x8A) | np.isin(a, (0xA8, 0xA9, 0xAF))
        out[some] = (b == 0xC2) & np.isin(a, (0x85, 0xA0)) | (c == 0xE2) & ((b == 0x80) & general | (b == 0x81) & (a == 0x9F)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    return out


def cut(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where chunks begin in UTF-8 data; `texts` has where each text begins, empty ones included."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = WHITE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = white[1:] & ~white[:-1] | MARKS[data[1:]] & LETTERS[data[:-1]]
    at = np.flatnonzero(begins)
    begins[at[after_wide_space(data, at) & white[at]]] = False
    begins[texts[texts < len(data)]] = True
    return np.flatnonzero(begins)


class Numbers(dict):
    """Numbers keys in the order in which they come; `fresh` has those not yet taken up."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def of(self, keys, size: int = -1) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, size)

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


class ChunkStore:
    """Ids of the chunks met so far. Subclasses give encode_strings()."""

    def __init__(self) -> None:
        self.powers = [_powers(b) for b in _BASE]
        self.reset()

    def reset(self) -> None:
        self.known = 0
        self._table(1 << 16)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        # Of each chunk: both hashes, its first id, its ids, its uses.
        self.first, self.second = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.start, self.count, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _table(self, size: int) -> None:
        self.shift, self.table, self.place = np.uint64(65 - size.bit_length()), np.zeros(size, np.uint64), np.zeros(size, np.int32)

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the strings one after another, ids of each string, bytes of each id)."""
        raise NotImplementedError

    # -- the table ----------------------------------------------------------------------------------------------------

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each chunk: -1 where it is not known, -2 where another one has its first hash."""
        out = np.full(len(first), -1, np.int64)
        todo, slot, last = np.arange(len(first)), (first >> self.shift).astype(np.int64), len(self.table) - 1
        key = first
        while len(todo):
            found = self.table[slot]
            hit = found == key
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (found != 0)
            todo, slot, key = todo[on], slot[on] + 1 & last, key[on]
        hit = np.flatnonzero(out >= 0)
        out[hit[self.second[out[hit]] != second[hit]]] = -2
        return out

    def _enter(self, numbers: np.ndarray) -> None:
        """Puts numbered chunks with distinct first hashes into the table."""
        last = len(self.table) - 1
        slot = (self.first[numbers] >> self.shift).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.table[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.table[slot[put]], self.place[slot[put]] = self.first[numbers[put]], numbers[put]
            left = np.ones(len(numbers), bool)
            left[put] = False
            numbers, slot = numbers[left], slot[left] + 1 & last

    def shrink(self) -> None:
        """Forgets chunks that were met once or twice, and more if that leaves over a quarter of what may be kept."""
        kept = np.flatnonzero(self.uses[: self.known] > 2)
        kept = kept[(self.first[kept] != 0) & (self.count[kept] <= LONG)]
        most = min(KEEP // 4, KEEP_IDS // (4 * LONG))
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:most]])
        first, second, start, count = (x[kept] for x in (self.first, self.second, self.start, self.count))
        ids = self.flat[ranges(start, count)]
        self.reset()
        self._append(ids, count, first, second)

    def _append(self, ids: np.ndarray, count: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of new chunks; a first hash of 0 keeps a chunk out of the table."""
        numbers = np.arange(self.known, self.known + len(count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(count) > len(self.start):
            self.first, self.second, self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.second, self.start, self.count, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[numbers], self.second[numbers], self.count[numbers] = first, second, count
        self.start[numbers] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.known += len(count)
        if 2 * self.known > len(self.table):
            self._table(1 << (4 * self.known).bit_length())
            self._enter(np.flatnonzero(self.first[: self.known]))
        else:
            self._enter(numbers[first != 0])
        return numbers

    # -- chunks -------------------------------------------------------------------------------------------------------

    def _learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Encodes chunks of data and returns their numbers."""
        end = begin + size
        # What begins with white space and ends otherwise keeps its bounds in one long string, which saves a call for each.
        joins = WHITE[data[begin]] & ~WHITE[data[end - 1]] & ~after_wide_space(data, end) & (size > 1)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        begin, size, end = begin[order], size[order], end[order]
        strings = [data[a:b].tobytes().decode() for a, b in zip(begin[n:].tolist(), end[n:].tolist(), strict=True)]
        if n:
            strings.insert(0, data[ranges(begin[:n], size[:n])].tobytes().decode())
        ids, each, width = self.encode_strings(strings)
        if n:
            bounds = np.searchsorted(np.cumsum(width[: each[0]]), np.cumsum(size[:n]), side="right")
            each = np.concatenate([np.diff(bounds, prepend=0), each[1:]])
        numbers = np.empty(len(order), np.int64)
        numbers[order] = self._append(ids, each, first[order], second[order])
        return numbers

    def _slots(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of each chunk of data, all learned; chunks follow one another and begin at `begin`."""
        if self.known > KEEP or self.used > KEEP_IDS:
            self.shrink()
        size = np.diff(begin, append=len(data))
        first, second = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
        short = size <= LONG
        at = 0
        with np.errstate(over="ignore"):
            while at < len(begin):
                to = max(at + 1, int(np.searchsorted(begin, begin[at] + BLOCK)))
                own = np.arange(at, to)[short[at:to]]
                if len(own):
                    low, high = int(begin[own[0]]), int(begin[own[-1]] + size[own[-1]])
                    # A long chunk inside is hashed too, but only the short ones' sums are read.
                    part = data[low : min(high, low + BLOCK + LONG)]
                    a, b = begin[own] - low, begin[own] - low + size[own]
                    for out, table, (power, inverse) in zip((first, second), _RANDOM, self.powers, strict=True):
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * power[: len(part)])])
                        x = (sums[b] - sums[a]) * inverse[a]
                        x ^= x >> np.uint64(31)
                        out[own] = x * np.uint64(0x94D049BB133111EB) | np.uint64(1)
                at = to
        out = np.full(len(begin), -2, np.int64)
        out[short] = self._find(first[short], second[short])
        new = np.flatnonzero(out == -1)
        if len(new):
            _, one, back = np.unique(first[new], return_index=True, return_inverse=True)
            chosen = new[one]
            same = second[chosen][back] == second[new]
            numbers = self._learn(data, begin[chosen], size[chosen], first[chosen], second[chosen])
            out[new] = np.where(same, numbers[back], -2)
        # Long chunks, and those whose first hash another one has, are encoded each time and stay out of the table.
        rest = np.flatnonzero(out == -2)
        if len(rest):
            none = np.zeros(len(rest), np.uint64)
            out[rest] = self._learn(data, begin[rest], size[rest], none, none)
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def _blocks(self, data: np.ndarray, begin: np.ndarray):
        """Numbers of at most CHUNKS chunks at a time; they hold until the next block."""
        for at in range(0, len(begin), CHUNKS):
            own = begin[at : at + CHUNKS]
            end = begin[at + CHUNKS] if at + CHUNKS < len(begin) else len(data)
            yield self._slots(data[own[0] : end], own - own[0])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, edges: text i has ids[edges[i]:edges[i + 1]])."""
        coded = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(coded), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))]).astype(np.int64)
        begin = cut(data, bounds[:-1])
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for slots in self._blocks(data, begin):
            sizes.append(self.count[slots])
            ids.append(self.flat[ranges(self.start[slots], sizes[-1])])
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))[np.searchsorted(begin, bounds)]

    def count_chunks(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk, none of them empty."""
        data = np.frombuffer("".join(chunks).encode(), np.uint8)
        size = np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks))
        return np.concatenate([np.zeros(0, np.int64), *(self.count[slots] for slots in self._blocks(data, np.cumsum(size) - size))])
