"""Intermediates that several parts of a plan read: Parquet in the shared working folder, which also ends their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A small table in fewer files than there are cores, dealt evenly: a file with one row group would be one task. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < most
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir; in a temporary one only in local mode, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="phrasemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evaluated(df: DataFrame) -> DataFrame:
    """df with its columns computed once, before any filter on them.

    The optimizer moves a filter below a projection by writing out each column that it mentions, again for each mention: columns that build on each other,
    as a decision's do, grow to hundreds of hashes and patterns a row. It moves none below a generator whose output it reads.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
