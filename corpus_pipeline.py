"""A corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the working folder and gives what it
reads there to the next. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import exact_dedup, langid, secrets_scan, simhash
from phrasemill.llm.common import crc_mod, materialize, spread
from phrasemill.llm.simhash import NO_ID
from phrasemill.llm.queries import pack_documents

#: A document stays if its language has this mean probability or more.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those whose language the classifier cannot tell; where nothing is labelled it can tell none. Every other row stays, repeated ones too."""
    net = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.keep_identified(docs, net, LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays: that of the smallest doc_id, of rows that repeat it any one, and a row without doc_id only where all lack one. Null texts count as empty."""
    rows = docs.select(*(F.col(c).alias(f"_{c}") for c in docs.columns))
    rows = rows.withColumns({"_row": F.coalesce(F.col("_doc_id").cast("bigint"), F.lit(NO_ID)), "_key": exact_dedup.digest_of(F.col("_text"))})
    found = exact_dedup.deduplicate(rows, exact_dedup.fresh_index(spark), id_col="_row", text_col="_text")
    kept = found.where("kept").select(F.col("doc_id").alias("_row"), F.col("digest").alias("_key"))
    # A digest has one id that stays, and the join has dealt the rows by both, so dropping repeats needs no further shuffle.
    one = rows.join(kept, ["_row", "_key"], "left_semi").dropDuplicates(["_row", "_key"])
    return one.select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays; a row without doc_id only where all lack one. Texts without words are alike. SimHash proposes pairs, MinHash those beyond its radius, the shingles decide."""
    copies = simhash.similar_documents(docs, words=5, similarity=0.8, radius=4)
    copies = copies.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_row"), F.col("text_hash").alias("_hash"))
    rows = docs.select(*(F.col(c).alias(f"_{c}") for c in docs.columns))
    rows = rows.withColumns({"_row": F.coalesce(F.col("_doc_id").cast("bigint"), F.lit(NO_ID)), "_hash": F.xxhash64("_text")})
    return rows.join(copies, ["_row", "_hash"], "left_anti").select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; every row stays, null and empty texts as they are. n_chars follows the text."""
    clean = secrets_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of every row and an end token, in pieces where they are more than the longest sequence holds, into sequences; null and empty texts are an end token alone."""
    # The workers of other stages need the memory of the codec.
    return pack_documents(docs, keep=False)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("secrets", secrets), ("packing", packed)]

#: The language stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
