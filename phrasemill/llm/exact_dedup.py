"""Exact deduplication against a persistent digest index (operator 8).

The index is a Parquet table bucketed and sorted by digest. A batch of documents becomes one row a digest (partial
aggregation, so a group of copies of any size is counted before the shuffle); these rows are anti-joined with the
index by sort-merge, in its own buckets, and what is new is appended.

Results: null text counts as empty; runs of ASCII white space equal one space; of equal texts the smallest id stays,
or the text that an earlier batch brought. A null id never stays, and keep_id is null where all copies lack one. Rows that repeat both id
and text are one document: each counts in group_size, and all are marked as kept if that document is. Empty tables give empty results.
Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, new_path


def normalised(text: F.Column) -> F.Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: F.Column) -> F.Column:
    """SHA-256 of the normalised UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id, batch) bucketed and sorted by digest, at `path`, registered in the session's catalog."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests of `groups` (digest, keep_id) that the index lacks, so a batch that comes again adds nothing. `batch` says which one brought a digest."""
        known = self.read().select("digest").hint("merge")
        new = groups.select("digest", F.col("keep_id").cast("bigint"), F.lit(batch).alias("batch")).join(known, "digest", "left_anti")
        # A table can't be read and appended to in one plan; the new digests are written first.
        new = materialize(new, "new-digests")
        new.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size (in this batch), kept, digest; the index gets the new digests."""
    hashed = materialize(digests(docs, id_col, text_col), "digests")
    groups = materialize(hashed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "groups")
    index.append_new(groups.select("digest", F.col("first_id").alias("keep_id")), batch)
    total = hashed.count()
    resolved = materialize(groups.join(index.read().select("digest", "keep_id").hint("merge"), "digest"), "resolved")
    return join_groups(hashed, resolved, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "digest"
    )


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the working folder, with as many buckets as a shuffle has partitions unless told otherwise."""
    return DigestIndex(spark, new_path(spark, "digest-index"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
