"""What the operators share: the working folder, written intermediates, Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text (or bytes of a payload) that a Python worker handles at once.
SLICE_CHARS = 500_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="phrasemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the working folder and reads it back: the lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A small table in fewer files than there are cores, dealt evenly: a file with one row group would be one task. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < most
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches, each with about `most` bytes of text at most, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > first and total + n > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(sizes):
            yield batch.slice(first)


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[pa.Array, list[str | None]], Iterator[pa.RecordBatch] | pa.RecordBatch]],
) -> DataFrame:
    """Applies a worker to (ids, texts) slices of df. `make` runs once a task and returns the worker; ids stay an Arrow array of their own type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = make()
        for part in text_slices(batches, "_text"):
            out = worker(part.column(0), part.column(1).to_pylist())
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def crc_mod(id_col: str, modulus: int) -> F.Column:
    """crc32 of an id written as text, modulo `modulus`: the folds of held-out documents."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is not to be broadcast.

    The planner takes the size of a written table from its compressed files and sees neither rows that explode() adds nor those of a group-by, so it may
    send a side to the driver that grows with the input.
    """
    return df.hint("merge")


#: Groups with a thousandth of all rows or more are heavy: at most 1,000 can be, so they may be broadcast.
HEAVY_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with groups (one row a key, with its number of rows in column `size`), inner.

    A heavy group would fill one task of a shuffled join, so heavy groups are broadcast to where the rows are and the rest is
    shuffled. Both frames must be written tables, since each is read more than once.
    """
    least = max(2, -(-total // HEAVY_SHARE))
    heavy = F.broadcast(groups.where(F.col(size) >= least).withColumn("_heavy", F.lit(True)))
    extra = [c for c in groups.columns if c != key]
    marked = rows.join(heavy, key, "left")
    hot = marked.where("_heavy").drop("_heavy")
    light = marked.where("_heavy is null").drop("_heavy", *extra).join(shuffled(groups.where(F.col(size) < least)), key)
    return light.unionByName(hot)
