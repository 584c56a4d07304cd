"""Edit-aware token counts (operator 9).

A document's chunks (pieces that pre-tokens never cross) are the leaves' contents of a segment tree; each node
holds the characters and tokens below it. An edit descends by characters to the leaves that it touches, together with the one
before and after where it borders on them; only their text is split and encoded again, and the sums above them are updated.
The leaves can be kept as a column beside the edited text: the next round of edits starts from them, and encodes nothing else.

Results: null and empty texts have no tokens; edits of a document apply in the order given, positions refer to the text at
that time, and what reaches beyond the text is cut off; null edits change nothing; equal texts get equal counts; repeated and null ids are rows of
their own; a kept tree whose leaves do not add up to the text's length is built anew; an empty table gives no rows.
Only the id, text, edits and tree columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, Vocabulary, _codec
from .chunks import CHUNK
from .common import text_slices

#: Chunks of a leaf when a tree is built; a leaf that grows to GROWN times as many has the tree built anew.
LEAF, GROWN = 32, 8
LEAVES = pa.struct([("chars", pa.int64()), ("tokens", pa.int64())])
EDITS = "array<struct<pos: bigint, removed: bigint, added: string>>"
#: The leaves of a tree, in order.
TREE = "array<struct<chars: bigint, tokens: bigint>>"


class TokenTree:
    """Token counts of one text under edits. An edit comes in two steps, so that a caller can have the chunks of many texts counted at once."""

    def __init__(self, text: str, chunks: list[str], counts: np.ndarray) -> None:
        self.text, self.encoded = text, 0
        self._build(chunks, counts)

    @classmethod
    def of(cls, codec: Codec, text: str) -> TokenTree:
        chunks = CHUNK.findall(text)
        return cls(text, chunks, codec.count_chunks(chunks))

    @classmethod
    def kept(cls, text: str, leaves: list[dict]) -> TokenTree:
        """The tree of leaves() of the same text."""
        tree = cls(text, [], np.zeros(0, np.int64))
        tree._grow([x["chars"] for x in leaves], [x["tokens"] for x in leaves])
        return tree

    def leaves(self) -> list[dict]:
        """Characters and tokens of each leaf that has any."""
        return [{"chars": c, "tokens": n} for c, n in zip(self.chars[self.base :], self.tokens[self.base :], strict=True) if c]

    def _build(self, chunks: list[str], counts: np.ndarray) -> None:
        counts = counts.tolist()
        spans = range(0, len(chunks), LEAF)
        self._grow([sum(map(len, chunks[i : i + LEAF])) for i in spans], [sum(counts[i : i + LEAF]) for i in spans])

    def _grow(self, chars: list[int], tokens: list[int]) -> None:
        self.base = 1 << (max(1, len(chars)) - 1).bit_length()
        # Plain lists: single nodes are read and written, which is slower in arrays.
        empty = [0] * (self.base - len(chars))
        self.chars, self.tokens = [0] * self.base + chars + empty, [0] * self.base + tokens + empty
        for x in (self.chars, self.tokens):
            for node in range(self.base - 1, 0, -1):
                x[node] = x[2 * node] + x[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """(leaf that has the character at pos, or the last one with any; where the leaf begins)."""
        chars, node, begin = self.chars, 1, 0
        pos = min(pos, max(0, chars[1] - 1))
        while node < self.base:
            node *= 2
            if pos - begin >= chars[node]:
                begin += chars[node]
                node += 1
        return node - self.base, begin

    def begin_edit(self, pos: int, removed: int, added: str) -> list[str]:
        """Changes the text and returns the chunks to be counted for finish_edit()."""
        size = len(self.text)
        pos = min(max(pos, 0), size)
        end = min(size, pos + max(removed, 0))
        # The characters just before and just after belong to it: a chunk may grow together with its neighbour.
        first, begin = self.leaf_at(max(0, pos - 1))
        last, at = self.leaf_at(end)
        region = self.text[begin:pos] + added + self.text[end : at + self.chars[self.base + last]]
        self.text = self.text[:pos] + added + self.text[end:]
        chunks = CHUNK.findall(region)
        grown = len(chunks) > GROWN * LEAF * (last - first + 1)
        self.encoded += len(self.text) if grown else len(region)
        self.pending = None if grown else (first, last), CHUNK.findall(self.text) if grown else chunks
        return self.pending[1]

    def finish_edit(self, counts: np.ndarray) -> None:
        place, chunks = self.pending
        if place is None:
            self._build(chunks, counts)
            return
        first, last = place
        counts = counts.tolist()
        share = -(-len(chunks) // (last - first + 1))
        for k in range(first, last + 1):
            own = slice((k - first) * share, (k - first + 1) * share)
            self.chars[self.base + k] = sum(map(len, chunks[own]))
            self.tokens[self.base + k] = sum(counts[own])
        lo, hi = (self.base + first) // 2, (self.base + last) // 2
        while lo:
            for x in (self.chars, self.tokens):
                for node in range(lo, hi + 1):
                    x[node] = x[2 * node] + x[2 * node + 1]
            lo, hi = lo // 2, hi // 2

    def edit(self, codec: Codec, pos: int, removed: int, added: str) -> None:
        self.finish_edit(codec.count_chunks(self.begin_edit(pos, removed, added)))


def counted(codec: Codec, pieces: list[list[str]]) -> list[np.ndarray]:
    """Token counts of several lists of chunks in one call."""
    counts = codec.count_chunks([c for p in pieces for c in p])
    return np.split(counts, np.cumsum([len(p) for p in pieces])[:-1]) if pieces else []


def edited_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_col: str | None = None, keep: bool = False) -> DataFrame:
    """(id, n_tokens, n_chars, n_edits, edited_tokens, edited_chars, reencoded_chars): counts before and after the edits.

    edits_col: array<struct<pos, removed, added>>, positions in code points. `reencoded_chars` is what the edits made it encode again.
    With `keep` come edited_text and tree, the leaves; with `tree_col` the texts' trees are taken from there, and where it has one nothing but
    the edited regions is encoded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "n_tokens", "n_chars", "n_edits", "edited_tokens", "edited_chars", "reencoded_chars"]

    def run(batches):
        codec = _codec(shared)
        for part in text_slices(batches, "_text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            leaves = [x if x is not None and sum(n["chars"] for n in x) == len(t) else None for x, t in zip(part.column(3).to_pylist(), texts, strict=True)]
            pieces = [CHUNK.findall(t) for t, x in zip(texts, leaves, strict=True) if x is None]
            built = zip(pieces, counted(codec, pieces), strict=True)
            trees = [TokenTree(t, *next(built)) if x is None else TokenTree.kept(t, x) for t, x in zip(texts, leaves, strict=True)]
            before = [t.total for t in trees]
            edits = [e or [] for e in part.column(2).to_pylist()]
            # The first edit of all texts, then the second, ...
            for k in range(max(map(len, edits), default=0)):
                some = [(t, e[k]) for t, e in zip(trees, edits, strict=True) if k < len(e) and e[k] is not None]
                changed = [t.begin_edit(e["pos"] or 0, e["removed"] or 0, e["added"] or "") for t, e in some]
                for (tree, _), n in zip(some, counted(codec, changed), strict=True):
                    tree.finish_edit(n)
            rows = [(n, len(t), len(e), x.total, len(x.text), x.encoded) for n, t, e, x in zip(before, texts, edits, trees, strict=True)]
            columns = [part.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))]
            if keep:
                columns += [pa.array([t.text for t in trees], pa.string()), pa.array([t.leaves() for t in trees], pa.list_(LEAVES))]
            yield pa.RecordBatch.from_arrays(columns, names + ["edited_text", "tree"] * keep)

    tree = F.col(tree_col) if tree_col else F.lit(None)
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(edits_col).cast(EDITS).alias("_edits"), tree.cast(TREE).alias("_tree"))
    schema = f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]) + f", edited_text string, tree {TREE}" * keep
    return given.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
