"""Near-duplicate vectors by product quantisation (operator 6).

Vectors are dealt to inverted lists by the nearest of two-level coarse centroids, so that the number of lists can follow the
number of vectors; the residual is coded by the nearest of 256 codes in each of SUBSPACES subspaces. A query goes to the PROBES
nearest lists. In a list, distances to codes come from the query's lookup tables; a vector is left out only where that distance, less the
vector's own coding error, shows it to be beyond the threshold. What remains is compared in double precision.

A pair is found where either of its vectors probes the list of the other, and it counts for both: a member carries the lists that
it probes itself, so a block knows whether the other side will see the pair too. What both miss is not found; README has the measured recall.

Centroids and codes are fitted on SAMPLE vectors at most, a documented bound; every vector is indexed and queried.
Equal vectors are one node, so copies cost no pairs. A list's vectors and its queries are dealt into blocks of bounded size, and
a block passes on counts and a spanning forest of its links, never the pairs. Vectors link only with those of their length; lengths
of which there are few vectors make one list each, compared whole.

Results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, their copies neither; a vector of
any other size, however small or large its components, is normalised without under- or overflow; repeated ids are rows of their own; a null
id is never the smallest; an empty table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize
from .components import components, spanning

#: Vectors that centroids and codes are fitted on at most.
SAMPLE = 16_384
SUBSPACES = 8
CODES = 256
#: Inverted lists: 2 * sqrt(vectors) of them, LEAST_LISTS at least. Up to COARSE have a centroid of their own; more are made of a coarse
#: centroid and one of a second level, fitted on what is left of the vectors.
LEAST_LISTS, COARSE = 8, 2048
#: Lists that a query looks into.
PROBES = 16
#: Vectors and queries of a block.
MEMBERS, QUERIES = 2048, 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; an empty centroid stays where it is."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(axis=1) / 2
    return np.concatenate([(norms - x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Coarse centroids (k, d), second-level ones (m, d) and codebooks (subspaces, codes, d of a subspace); list i * m + j has the sum of two centroids. d is padded to a multiple."""

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Index:
        x = padded(sample)
        coarse = kmeans(x, min(lists, COARSE, len(x)))
        left = x - coarse[nearest(x, coarse)]
        fine = kmeans(left, min(-(-lists // COARSE), len(x))) if lists > COARSE else np.zeros((1, x.shape[1]))
        index = cls(coarse, fine, np.zeros((SUBSPACES, 0, x.shape[1] // SUBSPACES)))
        residual = (x - index.centre(index.probes(x)[:, 0])).reshape(len(x), SUBSPACES, -1)
        index.books = np.stack([kmeans(np.ascontiguousarray(residual[:, s]), min(CODES, len(x)), rounds=5) for s in range(SUBSPACES)])
        return index

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The nearest lists of each row, at most PROBES, the nearest first: among those of the PROBES nearest coarse centroids."""
        k, m = min(PROBES, len(self.coarse)), len(self.fine)
        # Half the squared distances, less what all lists share.
        first = (self.coarse**2).sum(axis=1) / 2 - x @ self.coarse.T
        near = np.argpartition(first, k - 1, axis=1)[:, :k]
        second = (self.fine**2).sum(axis=1) / 2 - x @ self.fine.T
        total = np.take_along_axis(first, near, axis=1)[:, :, None] + second[:, None, :] + (self.coarse @ self.fine.T)[near]
        total, lists = total.reshape(len(x), -1), (near[:, :, None] * m + np.arange(m)).reshape(len(x), -1)
        order = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
        return np.take_along_axis(lists, order, axis=1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Codes of unit vectors x in their lists."""
        residual = (x - self.centre(own)).reshape(len(x), SUBSPACES, -1)
        return np.stack([nearest(np.ascontiguousarray(residual[:, s]), self.books[s]) for s in range(SUBSPACES)], axis=1).astype(np.uint8)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centre(own) + self.books[np.arange(SUBSPACES), codes].reshape(len(codes), -1)


def padded(x: np.ndarray) -> np.ndarray:
    more = -x.shape[1] % SUBSPACES
    return np.pad(x, ((0, 0), (0, more))) if more else x


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors, padded; each is scaled by its largest component first, so that no square under- or overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return padded(x / np.sqrt((x**2).sum(axis=1))[:, None])


def candidates(index: Index | None, members: dict, queries: np.ndarray, cosine: float):
    """(rows of queries, rows of members) that may have the cosine, some queries at a time; without an index all pairs."""
    if index is None:
        for at in range(0, len(queries), 512):
            n = len(queries[at : at + 512])
            yield np.repeat(np.arange(at, at + n), len(members["x"])), np.tile(np.arange(len(members["x"])), n)
        return
    decoded, exact = index.decoded(members["list"], members["codes"]), members["x"]
    error = np.sqrt(((exact - decoded) ** 2).sum(axis=1))
    limit = (np.sqrt(2 - 2 * cosine) + error + 1e-6) ** 2
    # |q - y|^2 = |q|^2 + |c + r|^2 - 2 q.c - 2 q.r: the last term is a sum over the query's table.
    norm = (decoded**2).sum(axis=1)
    own = index.centre(members["list"][:1])[0]
    used = [np.unique(members["codes"][:, s], return_inverse=True) for s in range(SUBSPACES)]
    for at in range(0, len(queries), 512):
        q = queries[at : at + 512]
        part = q.reshape(len(q), SUBSPACES, -1)
        dot = np.repeat((q @ own)[:, None], len(exact), axis=1)
        for s, (codes, place) in enumerate(used):
            table = part[:, s] @ index.books[s, codes].T
            dot += np.take(table, place, axis=1)
        i, j = np.nonzero((q**2).sum(axis=1)[:, None] + norm[None] - 2 * dot <= limit[None])
        yield at + i, j


def links_of(index: Index | None, members: dict, queries: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(linked rows of each query, and of each member that will not see the link itself, counting copies; links as a forest)."""
    of_query, of_member = np.zeros(len(queries["id"]), np.int64), np.zeros(len(members["id"]), np.int64)
    edges_a, edges_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in candidates(index, members, queries["x"], cosine):
        near = (queries["id"][i] != members["id"][j]) & (np.einsum("nd,nd->n", queries["x"][i], members["x"][j]) >= cosine)
        i, j = i[near], j[near]
        of_query += np.bincount(i, members["n"][j], minlength=len(of_query)).astype(np.int64)
        if index is not None:
            unseen = (members["probes"][j] != queries["list"][i, None]).all(axis=1)
            of_member += np.bincount(j[unseen], queries["n"][i[unseen]], minlength=len(of_member)).astype(np.int64)
        a, b = spanning(queries["id"][i], members["id"][j])
        edges_a.append(a)
        edges_b.append(b)
    return of_query, of_member, *spanning(np.concatenate(edges_a), np.concatenate(edges_b))


def valid(vector: F.Column) -> F.Column:
    """Whether a vector can link: no null or non-finite components, not zero or empty."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _indexed(nodes: DataFrame, total: int, kind: str, number: int) -> tuple[DataFrame, object]:
    """(vectors of one length as rows of their list and of the lists that they probe, the broadcast index)."""
    share = min(1.0, SAMPLE / total)
    sample = nodes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30) < share).select("v").limit(2 * SAMPLE).toArrow().column("v")
    if not len(sample):
        sample = nodes.select("v").limit(SAMPLE).toArrow().column("v")
    shared = nodes.sparkSession.sparkContext.broadcast(Index.fit(unit(sample), int(max(2 * total**0.5, LEAST_LISTS))))

    def assign(batches):
        index = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                vector, ids, size = part.columns
                x = unit(vector)
                probes = index.probes(x)
                own, n = probes[:, 0], probes.shape[1]
                codes = index.encode(x, own)
                carried = probes.astype(np.int32)
                for query in (False, True):
                    pick = pa.array(np.repeat(np.arange(len(x)), n) if query else np.arange(len(x)))
                    none = pa.nulls(len(pick), pa.binary())
                    binaries = [none, none] if query else [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, carried)]
                    lists = probes.reshape(-1) if query else own
                    columns = [pa.array(np.full(len(pick), number, np.int32)), pa.array(lists.astype(np.int64)), pa.array(np.full(len(pick), query))]
                    columns += [ids.take(pick), size.take(pick), pa.array(own.astype(np.int64)).take(pick), vector.take(pick), *binaries]
                    yield pa.RecordBatch.from_arrays(columns, ["index", "list", "query", "node", "n", "own", "v", "code", "probes"])

    schema = f"index int, list bigint, query boolean, node bigint, n bigint, own bigint, v {kind}, code binary, probes binary"
    return nodes.select("v", "node", "n").mapInArrow(assign, schema), shared


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links (other rows linked with it), component_id (smallest vec_id reachable)."""
    # Single-precision components stay so on their way, and are compared in double precision.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    given = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast(kind)).alias("v"))
    rows = materialize(given.select("vec_id", F.when(valid(F.col("v")), F.col("v")).alias("v")), "vectors")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where("v is not null")
    # Repeated ids would make one node of different vectors: nodes are numbered by their own row instead.
    nodes = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumns({"node": F.monotonically_increasing_id(), "d": F.size("v")}), "nodes")
    lengths = nodes.groupBy("d").agg(F.count("*").alias("k"))
    # Few lengths can have more than MEMBERS vectors each; usually there is one.
    large = {r["d"]: r["k"] for r in lengths.where(F.col("k") > MEMBERS).collect()}
    none = F.lit(None).cast("binary")
    # The vectors of any other length are one list, which each of them probes.
    small = nodes.where(~F.col("d").isin(list(large))) if large else nodes
    small = small.join(lengths.where("k > 1").select("d"), "d", "left_semi")
    small = small.select(F.lit(-1).alias("index"), F.col("d").cast("bigint").alias("list"), F.explode(F.array(F.lit(False), F.lit(True))).alias("query"), "node", "n", F.col("d").cast("bigint").alias("own"), "v", none.alias("code"), none.alias("probes"))
    parts = [_indexed(nodes.where(F.col("d") == d), k, f"array<{kind}>", i) for i, (d, k) in enumerate(sorted(large.items()))]
    indexes = [shared for _, shared in parts]
    assigned = materialize(reduce(DataFrame.unionByName, [small, *(p for p, _ in parts)]), "assigned")
    blocks = lambda query, size: F.ceil(F.count_if(F.col("query") if query else ~F.col("query")) / size)
    sizes = assigned.groupBy("index", "list").agg(blocks(False, MEMBERS).alias("mb"), blocks(True, QUERIES).alias("qb")).where("mb > 0 and qb > 0")
    # A row a list: 2 * sqrt(vectors) of them, and a row a further length, of which there are fewer than sqrt(2 * components).
    sizes = F.broadcast(sizes)
    mix = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    # A member meets every block of queries, a query every block of members; hot lists have more blocks, not larger ones.
    dealt = assigned.join(sizes, ["index", "list"]).withColumns({
        "own_block": mix % F.when(F.col("query"), F.col("qb")).otherwise(F.col("mb")),
        "other": F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb")) - 1)),
    })
    place = {"m": F.when(F.col("query"), F.col("other")).otherwise(F.col("own_block")), "q": F.when(F.col("query"), F.col("own_block")).otherwise(F.col("other"))}
    names = ["index", "list", "m", "q", "query"]
    ordered = dealt.select("index", "list", *(x.cast("bigint").alias(k) for k, x in place.items()), "query", "node", "n", "own", "v", "code", "probes").repartition(*names[:4]).sortWithinPartitions(*names)

    def compare(batches):
        key, members, waiting = None, [], []

        def done():
            if not members or not waiting:
                return
            (mt, qt) = (pa.Table.from_batches(x) for x in (members, waiting))
            index = indexes[key[0]].value if key[0] >= 0 else None
            as_rows = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
            m, q = ({"id": t.column("node").to_numpy(), "n": t.column("n").to_numpy(), "list": t.column("own").to_numpy(), "x": unit(t.column("v"))} for t in (mt, qt))
            if index is not None:
                m |= {"codes": as_rows(mt.column("code"), np.uint8), "probes": as_rows(mt.column("probes"), np.int32)}
            of_query, of_member, a, b = links_of(index, m, q, cosine)
            for ids, links in ((q["id"], of_query), (m["id"], of_member)):
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.nulls(int(some.sum()), pa.int64())], ["a", "links", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(b)], ["a", "links", "b"])

        for batch in batches:
            named = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            query = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(named, axis=0) != 0).any(axis=1) | (np.diff(query.astype(np.int8)) != 0)) + 1, [len(named)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if key != tuple(named[lo].tolist()):
                    yield from done()
                    key, members, waiting = tuple(named[lo].tolist()), [], []
                (waiting if query[lo] else members).append(batch.slice(lo, hi - lo))
        yield from done()

    found = materialize(ordered.mapInArrow(compare, "a bigint, links bigint, b bigint"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = nodes.select("v", "id", "n", "node").join(counts.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    named = materialize(named.select("v", "id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = materialize(named.join(least, "root").select("v", "n", "links", "component_id"), "labels")
    return join_groups(rows, labels, "v", "n", rows.count()).select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id").unionByName(alone)
