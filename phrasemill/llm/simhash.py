"""SimHash fingerprints and near-duplicate groups by covering LSH (operator 2).

A fingerprint holds, for each of 64 bits, whether more than half of the hashes of the text's word shingles set it.
Equal fingerprints are one node. Nodes within `radius` differing bits are found by covering LSH: each bit position has a
nonzero vector m(i) of radius + 1 bits, and table t (t = 1 .. 2^(radius+1) - 1) hashes the positions with odd parity of
m(i) & t. For at most `radius` differing positions some t is orthogonal to all their vectors, so any such pair agrees on
everything that table t hashes: none is missed. A bucket of up to BUCKET nodes is compared whole; the nodes of larger ones
meet through the words halfway between them (2 + 2 bits), a number of rows linear in the nodes, each meeting at most
2,081 of them. Every task gives a spanning forest of its links, never all pairs.

similar_documents() decides by the similarity of the texts' shingle sets: near fingerprints propose pairs as above. Since most pairs at a
similarity of 0.8 have fingerprints farther apart, bands of smallest shingle hashes (MinHash) propose the others by that similarity alone, whatever the shape of an edit, sketches decide those
far from the similarity, and the sets themselves the others.

Results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle; equal texts share a fingerprint; rows that repeat an id are rows of their own; a null id is never the smallest of a group;
empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, map_texts, materialize, shuffled
from .components import components, spanning

SEED = 42
#: Nodes of a bucket that one task compares pair by pair.
BUCKET = 4096
#: Links that a task holds before it passes them on as a forest.
HELD = 200_000


def simhash(text: str | None, words: int) -> int:
    """Fingerprint of one text: A-Z in lower case, shingles of `words` words with repeats, XXH64."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    if n <= 1:
        return digest(joined, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    counts = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 14):
        last = min(n, first + (1 << 14))
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[first:last].tolist(), ends[first + words - 1 : last + words - 1].tolist(), strict=True)),
            np.uint64,
            last - first,
        )
        counts += bit_counts(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit: bits of 255 rows at a time are added up eight to a word."""
    out = np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    for first in range(0, len(hashes), 255 * 64):
        some = hashes[first : first + 255 * 64]
        block = np.zeros(-(-len(some) // 255) * 255, np.uint64)
        block[: len(some)] = some
        block = block.reshape(255, -1)
        for shift in range(8):
            sums = ((block >> np.uint64(shift)) & lanes).sum(axis=0, dtype=np.uint64)
            # Byte k of a sum counts bit 8 * k + shift.
            out[shift::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint): the fingerprint's 64 bits as a signed number."""

    def make():
        def work(keys, texts):
            fps = np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([keys, pa.array(fps)], ["doc_id", "fp"])

        return work

    return map_texts(docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col), id_col, text_col, "doc_id bigint, fp bigint", make)


def masks(radius: int) -> list[int]:
    """The positions that each table hashes."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & t).bit_count() & 1) for t in range(1, 2 ** (radius + 1))]


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Actual pairs within radius that connect what all such pairs connect, the nearest ones (Prim's algorithm)."""
    n = len(x)
    reach, via = np.full(n, 65, np.int64), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    a, b = [], []
    for _ in range(n):
        k = int(np.where(out, reach, 99).argmin())
        if reach[k] <= radius:
            a.append(k)
            b.append(int(via[k]))
        out[k] = False
        d = np.bitwise_count(x ^ x[k])
        nearer = d < reach
        reach[nearer], via[nearer] = d[nearer], k
    return x[a], x[b]


def buckets_of(batches, tables: int):
    """(group, fingerprints) of each bucket of sorted rows (t, k, fp); a task holds a batch and one bucket."""
    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        t, k, fp = (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1]).tolist() if len(t) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(t[lo]) // tables, fp[lo:hi]
        rest = [x[cuts[-1] :] for x in (t, k, fp)]
    if len(rest[0]):
        yield int(rest[0][0]) // tables, rest[2]


def near_links(nodes: DataFrame, radius: int, pairs: bool = False) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs within `radius` bits do. nodes: distinct (fp), or (g, fp) for separate groups g.

    With `pairs` each link is itself a pair within the radius.
    """
    tables = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    if "g" not in nodes.columns:
        nodes = nodes.withColumn("g", F.lit(0))
    keys = F.explode(F.array(*[F.struct((F.col("g") * len(tables) + t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)]))
    keyed = nodes.select("g", "fp", keys.alias("x")).select("g", "fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(shuffled(sizes), ["t", "k"]), "buckets")

    def compare(batches):
        found: dict[int, tuple[list, list]] = {}

        def flush():
            for g, (a, b) in found.items():
                p, q = np.concatenate(a), np.concatenate(b)
                if not pairs:
                    p, q = spanning(p, q)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), g, np.int32)), pa.array(p), pa.array(q)], ["g", "a", "b"])
            found.clear()

        held = 0
        for g, fp in buckets_of(batches, len(tables)):
            x = fp.view(np.uint64)
            a, b = found.setdefault(g, ([], []))
            if len(x) == 2 or not pairs:
                for first in range(0, len(x), 512):
                    i, j = np.nonzero(np.bitwise_count(x[first : first + 512, None] ^ x[None, first:]) <= radius)
                    up = i < j
                    p, q = x[i[up] + first].view(np.int64), x[j[up] + first].view(np.int64)
                    if len(p) > len(x):
                        p, q = spanning(p, q)
                    a.append(p)
                    b.append(q)
                    held += len(p)
            else:
                p, q = forest(x, radius)
                a.append(p.view(np.int64))
                b.append(q.view(np.int64))
                held += len(p)
            if held > HELD or len(a) > HELD:
                yield from flush()
                held = 0
        yield from flush()

    ordered = shared.where(F.col("n") <= BUCKET).select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
    small = ordered.mapInArrow(compare, "g int, a bigint, b bigint")

    # Nodes at most 2 * (radius // 2) apart share a word at most radius // 2 bits from either; an odd radius needs one bit more on one side.
    half, odd = radius // 2, radius % 2
    flips = [sum(1 << p for p in c) for size in range(half + odd + 1) for c in combinations(range(64), size)]
    wide = np.array(flips, np.uint64)

    def midway(batches):
        for batch in batches:
            g, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for first in range(0, len(fps), 64):
                some = fps[first : first + 64]
                z = (some[:, None] ^ wide[None, :]).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g[first : first + 64], len(wide))), pa.array(z), pa.array(np.repeat(some.view(np.int64), len(wide)))], ["g", "z", "fp"])

    hot = shared.where(F.col("n") > BUCKET).select("g", "fp").distinct()
    met = hot.mapInArrow(midway, "g int, z bigint, fp bigint").groupBy("g", "z").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    if odd:
        # Words radius // 2 + 1 away on both sides may join nodes radius + 1 apart: check the pairs of each word's nodes.
        large = met.select("g", F.explode("all").alias("a"), "all").select("g", "a", F.explode("all").alias("b")).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    else:
        large = met.select("g", F.explode("all").alias("a"), "b").where("a <> b")
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id reachable by links, itself included)."""
    prints = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    found = components(near_links(nodes.select("fp"), radius).select("a", "b"))
    roots = nodes.join(shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("root"))
    roots = materialize(roots, "roots")
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialize(roots.join(shuffled(least), "root").select("fp", "n", "component_id"), "labels")
    return join_groups(prints, labels, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


#: Smallest hashes in a band's key, and the chance at most that a pair at the similarity shares no band.
ROWS, MISS = 6, 1e-6
#: Shingles that are hashed at once.
ROUND = 256
#: Cells of a sketch, a byte each; the estimate of a similarity of 0.8 has a standard deviation of 0.02 for long texts, less for short ones.
CELLS = 384
#: Standard deviations between the similarity and an estimate that decides without the sets.
SURE = 5
#: Shingle hashes of a block's sets, and queries of a block.
BLOCK_HASHES, QUERIES = 1 << 17, 512
#: Rows of 16 bytes that may be broadcast.
FEW_ROWS = 500_000
#: Stands for a null id.
NO_ID = (1 << 63) - 1
#: Filled cells below which an estimate accepts nothing and rejects at double the distance: cells shared by chance weigh more there.
FEW = 256


def n_bands(similarity: float) -> int:
    """Bands that a pair at the similarity misses with a chance of MISS at most, whatever the difference looks like: 46 at 0.8."""
    share = similarity**ROWS
    return 1 if share >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-share)))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Shingle hashes with repeats; fewer words than a shingle make one shingle, and so does no word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = len(parts) - words + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, words))


#: The only shingle of a text without words, whose fingerprint is zero.
NO_WORDS = xxhash.xxh64_intdigest(b"", SEED)


def fingerprint_of(hashes: np.ndarray) -> int:
    """simhash() of a text from its shingle hashes, as a signed number."""
    if len(hashes) == 1 and int(hashes[0]) == NO_WORDS:
        return 0
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (x, y) of sets s whose fingerprints fp are within the radius: a spanning forest of them. prints: distinct (s, fp)."""
    least = materialize(prints.groupBy("fp").agg(F.min("s").alias("y")), "print-nodes")
    same = prints.join(least, "fp").where("s <> y").select(F.col("s").alias("x"), "y")
    links = near_links(least.select("fp"), radius, pairs=True).select("a", "b")
    ends = links.join(least.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(least.select(F.col("fp").alias("b"), "y"), "b")
    return same.unionByName(ends.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))).distinct()


def set_digest(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a set of shingle hashes."""
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def least_hashes(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each of several random 32-bit hashes over a set."""
    out = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(short), ROUND):
        x = short[first : first + ROUND, None] * factors
        x += shifts
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row of smallest hashes."""
    rows = least.reshape(len(least), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for i in range(ROWS):
        key = (key ^ rows[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key = (key ^ (key >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        key = key ^ (key >> np.uint64(29))
    return key.view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation sketch of a set of shingle hashes: the smallest of each cell, 0 where the cell is empty."""
    cell, value = hashes % np.uint64(CELLS), hashes >> np.uint64(24)
    least = np.full(CELLS, np.iinfo(np.uint64).max)
    np.minimum.at(least, cell.astype(np.int64), value)
    empty = least == np.iinfo(np.uint64).max
    short = (least % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    short[empty] = 0
    return short.tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches; equal to 1 where both are empty."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(filled > 0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1), 1.0)


def estimated(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) that may have the similarity by their sketches, as (a, b, sure); `sure` where they certainly have it."""
    both = pairs.join(sketches.select(F.col("s").alias("x"), F.col("sketch").alias("sx")), "x").join(sketches.select(F.col("s").alias("y"), F.col("sketch").alias("sy")), "y")
    far = SURE * (similarity * (1 - similarity) / CELLS) ** 0.5

    def accept(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS) for i in (2, 3))
                likely, few = alike(a, b), ((a != 0) | (b != 0)).sum(axis=1) < FEW
                sure = (likely >= similarity + far) & ~few
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(likely >= similarity - far * np.where(few, 2, 1)))

    return both.select("x", "y", "sx", "sy").mapInArrow(accept, "a bigint, b bigint, sure boolean")


def verified(likely: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of estimated() that have the similarity: those not sure are decided by the sets of shingle hashes themselves."""
    unsure = likely.where("not sure").select("a", "b")
    both = unsure.join(sets.select(F.col("s").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("s").alias("b"), F.col("hashes").alias("hb")), "b")

    def decide(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return likely.where("sure").select("a", "b").unionByName(both.select("a", "b", "ha", "hb").mapInArrow(decide, "a bigint, b bigint"))


def block_links(shared: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between sets of one band that the links so far leave in different components: decided by the sets themselves.

    Pairs with a band's first set are settled. The others are compared within blocks: the sets outside a band's largest component are
    its queries, against all sets of the band. A block gives links that join components, never pairs, and bands of any size
    make more blocks, not larger ones.
    """
    labels = found.select(F.col("node").alias("s"), "component")
    marked = materialize(shared.join(labels, "s", "left").select("key", "s", "size", "low", F.coalesce("component", "s").alias("c")), "marked")
    counts = marked.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum("size").alias("hashes"))
    bands = counts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), F.sum("hashes").alias("hashes"))
    ceiling = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    mixed = bands.where("k > top.k").select("key", F.col("top.c").alias("most"), ceiling(F.col("hashes"), BLOCK_HASHES).alias("mb"), ceiling(F.col("k") - F.col("top.k"), QUERIES).alias("qb"))
    rest = materialize(marked.where("s <> low").join(mixed, "key").select("key", "s", "c", (F.col("c") != F.col("most")).alias("asks"), "mb", "qb"), "unsettled")
    place = lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda m, q, query: F.struct(m.alias("m"), q.alias("q"), F.lit(query).alias("query"))
    own_m, own_q = place("mb"), place("qb")
    spots = F.concat(
        F.transform(upto("qb"), lambda q: at(own_m, q, False)),
        F.when(F.col("asks"), F.transform(upto("mb"), lambda m: at(m, own_q, True))).otherwise(F.array().cast("array<struct<m: int, q: int, query: boolean>>")),
    )
    dealt = rest.join(sets, "s").select("key", "s", "c", "asks", "hashes", F.explode(spots).alias("x")).select("key", "x.m", "x.q", "x.query", "s", "c", "asks", "hashes")

    def compare(batches):
        block: SetBlock | None = None
        name = None
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            query, s, c, asks, hashes = (batch.column(i) for i in range(3, 8))
            out: list[tuple[int, int]] = []
            for i, (own, is_query) in enumerate(zip(names, query.to_pylist(), strict=True)):
                if own != name:
                    block, name = SetBlock(similarity), own
                values = np.frombuffer(hashes[i].as_buffer(), np.uint64)
                if is_query:
                    out += block.ask(s[i].as_py(), c[i].as_py(), values)
                else:
                    block.add(s[i].as_py(), c[i].as_py(), asks[i].as_py(), values.copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    ordered = dealt.repartition("key", "m", "q").sortWithinPartitions("key", "m", "q", "query")
    return ordered.mapInArrow(compare, "a bigint, b bigint")


class SetBlock:
    """Sets of one block; ask() compares one set with all of them at once."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.rows, self.sets, self.root = similarity, [], [], {}
        self.codes = None

    def add(self, s: int, c: int, asks: bool, hashes: np.ndarray) -> None:
        self.rows.append((s, c, asks))
        self.sets.append(hashes)

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            c = up
        return c

    def close(self) -> None:
        self.s, self.c, self.asks = (np.array(x) for x in zip(*self.rows, strict=True))
        self.size = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        self.starts = np.cumsum(self.size) - self.size
        self.known, self.codes = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.mark = np.zeros(len(self.known), bool)
        self.sets = []

    def ask(self, s: int, c: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Links of a set with sets of other components; of two sets that both ask the smaller one finds the other."""
        if not self.rows:
            return []
        if self.codes is None:
            self.close()
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = at[self.known[at] == hashes]
        self.mark[at] = True
        common = np.add.reduceat(self.mark[self.codes], self.starts, dtype=np.int64)
        self.mark[at] = False
        near = (common >= self.similarity * (len(hashes) + self.size - common)) & (self.c != c) & (~self.asks | (self.s > s))
        out = []
        for j in np.flatnonzero(near).tolist():
            x, y = self.find(c), self.find(int(self.c[j]))
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out.append((s, int(self.s[j])))
        return out


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id) of each document that is linked to one with a smaller id; the others are their own component.

    Links are pairs whose sets of shingles have a similarity of `similarity` or more; an estimate decides only SURE deviations away. Equal sets are one node. Pairs
    of sets whose SimHash fingerprints are within the radius are proposed first. The others, which are most at a similarity of 0.8, are looked at where they share
    a band: each with the band's first set, then all that verified links leave apart.

    text_hash is xxhash64 of the text: with it the result names rows also where documents share an id, and among those the one of smallest
    text_hash is the first. A null id counts as larger than any other, and is given as null. Null and empty texts are one empty set.
    """
    size = n_bands(similarity) * ROWS
    rng = np.random.default_rng(SEED)
    factors, shifts = rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, size, np.uint32)

    def make():
        def work(keys, texts):
            every = [shingle_hashes(t, words) for t in texts]
            prints, sets = list(map(fingerprint_of, every)), list(map(np.unique, every))
            bands = band_keys(np.array([least_hashes(h, factors, shifts) for h in sets]).reshape(-1, size))
            edges = np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]
            fields = [keys.field(0), keys.field(1)]
            columns = [*fields, pa.array(list(map(set_digest, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64())]
            columns += [pa.array(list(map(sketch, sets)), pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(bands.reshape(-1))), pa.array(prints, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "s", "size", "sketch", "bands", "fp"])

        return work

    def hashed():
        def work(keys, texts):
            sets = [shingle_set(t, words) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(list(map(set_digest, sets)), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["s", "hashes"])

        return work

    text = F.col(text_col)
    given = docs.select(F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("row"), text.alias("text"))
    profiles = map_texts(given, "row", "text", "doc_id bigint, text_hash bigint, s bigint, size bigint, sketch binary, bands array<bigint>, fp bigint", make)
    # Rows are numbered as they are written, so that one row stands for a set also where rows repeat.
    profiles = materialize(profiles.withColumn("number", F.monotonically_increasing_id()), "profiles")
    row = F.struct("doc_id", "text_hash")
    nodes = materialize(profiles.groupBy("s").agg(F.min(F.struct("doc_id", "text_hash", "number")).alias("row"), F.count("*").alias("n")), "nodes")
    keyed = profiles.select("s", "size", F.explode("bands").alias("key")).repartition("key")
    ends = keyed.groupBy("key").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low < high")
    shared = materialize(keyed.join(ends, "key").select("key", "s", "size", "low").distinct(), "shared")
    close = materialize(fingerprint_pairs(profiles.select("s", "fp").distinct(), radius), "close-prints")
    members = shared.select("s").unionByName(close.select(F.col("x").alias("s"))).unionByName(close.select(F.col("y").alias("s"))).distinct().join(nodes, "s").select("row.number")
    sketches = materialize(profiles.join(members, "number").select("s", "doc_id", "text_hash", "sketch"), "sketches")
    first = shared.where("s <> low").select(F.col("s").alias("x"), F.col("low").alias("y")).unionByName(close).distinct()
    chosen = sketches.select("doc_id", "text_hash")
    # Few candidates go to the texts; else the texts are dealt by row.
    chosen = F.broadcast(chosen) if chosen.count() <= FEW_ROWS else chosen
    owners = given.select("row.doc_id", "row.text_hash", "text").join(chosen, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    sets = materialize(map_texts(owners, "doc_id", "text", "s bigint, hashes binary", hashed), "sets")
    likely = materialize(estimated(first, sketches, similarity), "likely")
    links = materialize(verified(likely, sets, similarity), "first-links")
    more = block_links(shared, components(links), sets, similarity)
    found = components(links.unionByName(more))
    roots = materialize(nodes.join(found.withColumnRenamed("node", "s"), "s", "left").select("s", F.struct("row.doc_id", "row.text_hash").alias("row"), "n", F.coalesce("component", "s").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("row").alias("least"))
    labels = materialize(roots.join(least, "root").select("s", "n", "least"), "labels")
    labelled = join_groups(profiles.select("doc_id", "text_hash", "s"), labels, "s", "n", profiles.count()).where(row > F.col("least"))
    given_id = lambda x: F.nullif(x, F.lit(NO_ID))
    return labelled.select(given_id(F.col("doc_id")).alias("doc_id"), "text_hash", given_id(F.col("least.doc_id")).alias("component_id")).distinct()
