"""Best-fit packing into bins of several permitted sizes (operator 7).

A document longer than the largest size is cut into full pieces and a rest. Pieces are packed by best fit, longest first: each goes to the
open bin with the least room that holds it. Where none does, a bin opens of the size that costs least for what it is going to hold: that
is looked up ahead, by filling each size with the largest of the pieces that are left. At the end each bin takes the smallest
permitted size that holds its contents.

A bin costs its length, the work of attention, which grows with the square of the length, and something by itself (see Cost). Small bins
save attention and padding, large ones overhead and leftovers, so which is least depends on the lengths at hand. The lengths of a group
are therefore packed by several plans, with all sizes by looking ahead and with each size alone, and the plan of least total cost is taken:
the result never costs more than packing with one size.

Each task packs its own rows, GROUP pieces at a time: nothing is shuffled, so no key can be hot, and memory is bounded.
A bin's id is the task's number and a count, so a task that runs again gives the same bins.

Results: rows whose length is null, zero or negative are left out, as there is nothing to place; repeated rows and null ids are packed each;
pieces of equal length keep their order; of plans that cost the same the first is taken; an empty table gives no rows. Only the id and length columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that are packed together.
GROUP = 20_000


@dataclass(frozen=True)
class Cost:
    """Cost of a bin in tokens: overhead, its length, and its length squared over `attention`, the length at which attention costs as much as all else."""

    overhead: int = 64
    attention: int = 16_384

    def __call__(self, size: int) -> float:
        return self.overhead + size + size * size / self.attention


class Left:
    """The pieces that are not placed yet, as counts of lengths."""

    def __init__(self, lengths: list[int]) -> None:
        found, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
        self.lengths, self.counts = found.tolist(), counts.tolist()
        # For a length that is used up, a smaller one to look at.
        self.lower = list(range(len(self.lengths)))

    def take(self, n: int) -> None:
        k = bisect_left(self.lengths, n)
        self.counts[k] -= 1
        if not self.counts[k]:
            self.lower[k] = k - 1

    def largest(self, room: int) -> int:
        """Place of the largest length left that fits, -1 if none does."""
        k = bisect_right(self.lengths, room) - 1
        path = []
        while k >= 0 and self.lower[k] != k:
            path.append(k)
            k = self.lower[k]
        for p in path:
            self.lower[p] = k
        return k

    def filled(self, size: int) -> int:
        """What a bin of the size holds when it is filled with the largest pieces that fit, one after another."""
        room, place = size, self.largest(size)
        while place >= 0:
            n = self.lengths[place]
            fits = min(self.counts[place], room // n)
            room -= fits * n
            # The same length again only where it was not used up.
            place = self.largest(min(room, n - 1))
        return size - room


def fit(lengths: list[int], sizes: tuple[int, ...], opens: tuple[int, ...], cost: Cost) -> tuple[list[int], list[int]]:
    """(bin of each piece, size of each bin): best fit, longest first, where bins open with the sizes in `opens`, or the smallest size that holds the piece."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = Left(lengths) if len(opens) > 1 else None
    room: list[tuple[int, int]] = []
    where, held = [0] * len(lengths), []
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(held)
            held.append(0)
            hold = [s for s in opens if s >= n] or [sizes[bisect_left(sizes, n)]]
            # The piece itself is the largest that is left, so it is the first in each size.
            free = hold[0] if len(hold) == 1 or left is None else min(hold, key=lambda s: (cost(s) / left.filled(s), s))
        where[i] = b
        held[b] += n
        if left is not None:
            left.take(n)
        if free > n:
            insort(room, (free - n, b))
    return where, [sizes[bisect_left(sizes, h)] for h in held]


def best_fit(lengths: list[int], sizes: tuple[int, ...], cost: Cost = Cost()) -> tuple[list[int], list[int]]:  # noqa: B008
    """(bin of each piece, size of each bin) by the plan of least cost. Every length is between 1 and the largest size."""
    sizes = tuple(sorted(set(sizes)))
    plans = [sizes] + [(s,) for s in sizes if len(sizes) > 1]
    packed = (fit(lengths, sizes, opens, cost) for opens in plans)
    return min(packed, key=lambda p: sum(map(cost, p[1])))


def pack(rows: DataFrame, sizes: tuple[int, ...], id_col: str = "doc_id", length_col: str = "length", cost: Cost = Cost()) -> DataFrame:  # noqa: B008
    """One row a piece: id, piece (from 0), piece_start, piece_length, bin_id, bin_size, bin_offset."""
    sizes = tuple(sorted(set(sizes)))
    largest = sizes[-1]
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["_id", "piece", "piece_start", "piece_length", "bin_id", "bin_size", "bin_offset"]

    def run(batches):
        task, opened = TaskContext.get().partitionId() << 36, 0
        ids, pieces, starts, lengths, key = [], [], [], [], None

        def flush():
            nonlocal opened
            where, size = best_fit(lengths, sizes, cost)
            bins = np.array(where, np.int64)
            order = np.argsort(bins, kind="stable")
            n = np.array(lengths, np.int64)
            before = np.cumsum(n[order]) - n[order]
            first = np.concatenate([[True], np.diff(bins[order]) != 0])
            offset = np.empty(len(n), np.int64)
            offset[order] = before - np.repeat(before[first], np.bincount(bins))
            yield pa.RecordBatch.from_arrays([pa.array(ids, key), *(pa.array(np.asarray(x, np.int64)) for x in (pieces, starts, n, task + opened + bins, np.array(size)[bins], offset))], names)
            opened += len(size)
            for x in (ids, pieces, starts, lengths):
                x.clear()

        for batch in batches:
            key = batch.schema.field(0).type
            for own, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in range(-(-length // largest)):
                    ids.append(own)
                    pieces.append(piece)
                    starts.append(piece * largest)
                    lengths.append(min(largest, length - piece * largest))
                    if len(ids) >= GROUP:
                        yield from flush()
        if ids:
            yield from flush()

    given = rows.select(F.col(id_col).alias("_id"), F.col(length_col).cast("bigint").alias("_length")).where("_length > 0")
    return given.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])).withColumnRenamed("_id", id_col)
