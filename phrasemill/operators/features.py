"""Features of phrases: exact character tf-idf in long form, and dense vectors from an embedding provider."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = (3, 4, 5)


def char_grams(text: Column) -> Column:
    """The 3- to 5-grams of each token with a space at either end; a token no longer than n gives itself once and stops."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))

    def windows(t: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(t) - size + 1, F.lit(1)))
        return F.transform(starts, lambda s: F.substring(t, s, F.lit(size)))

    def of(t: Column) -> Column:
        # A token of at most a smaller size has already given itself.
        none = F.array().cast("array<string>")
        return F.concat(*[windows(t, n) if n == SIZES[0] else F.when(F.char_length(t) > n - 1, windows(t, n)).otherwise(none) for n in SIZES])

    return F.flatten(F.transform(padded, of))


def char_tfidf(df: DataFrame, key: str, text: str, features: int = 20_000, sublinear: bool = True, least_df: int = 1) -> DataFrame:
    """(key, gram, weight): L2-normalised tf-idf; idf is ln((1 + N) / (1 + df)) + 1, the grams of the highest total count are kept."""
    rows = df.select(key, F.col(text).alias("_t"))
    tf = rows.select(key, F.explode(char_grams(F.col("_t"))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    counts = tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_df)
    # The vocabulary is a bounded top-k, so it may be broadcast.
    kept = counts.orderBy(F.desc("total"), "gram").limit(features).crossJoin(rows.agg(F.count("*").alias("n")))
    weight = (1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")) * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)
    weighted = tf.join(F.broadcast(kept.select("gram", "df", "n")), "gram").select(key, "gram", weight.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "gram", (F.col("w") / norm).alias("weight"))


def similarities(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, similarity) of rows that share a gram, from char_tfidf of both. For labelled samples, which are bounded by the sampling."""
    pairs = a.select(F.col(left), "gram", F.col("weight").alias("_x")).join(b.select(F.col(right), "gram", F.col("weight").alias("_y")), "gram")
    return pairs.groupBy(left, right).agg(F.sum(F.col("_x") * F.col("_y")).alias("similarity"))


def neighbour_conflict(candidates: DataFrame, labelled: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """(key, conflict): whether the n labelled rows most similar to a candidate have both intents. candidates, labelled: char_tfidf with keys key and other; labels: (other, label)."""
    sims = similarities(candidates, labelled, "key", "other").withColumn("similarity", F.rint(F.col("similarity") * 1e9) / 1e9)
    near = sims.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "other"))).where(F.col("_n") <= n)
    found = near.join(labels, "other").groupBy("key").agg(F.array_distinct(F.collect_list("label")).alias("l"))
    return found.select("key", (F.array_contains("l", "commercial") & F.array_contains("l", "informational")).alias("conflict"))


def novelty(candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """(key, novelty): 1 less the largest similarity to a relevant row."""
    best = similarities(candidates, relevant, "key", "other").groupBy("key").agg(F.max("similarity").alias("s"))
    return candidates.select("key").distinct().join(best, "key", "left").select("key", (1.0 - F.coalesce("s", F.lit(0.0))).alias("novelty"))


# -- dense vectors -----------------------------------------------------------------------------------------------------------------


class EmbeddingProvider(Protocol):
    """Gives unit vectors of texts; instances go to the workers, so they load what is large when first called."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedGrams:
    """Signed hashed character grams: a provider that needs no model."""

    def __init__(self, dimension: int = 256) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        """All grams of all texts at once: a rolling hash over their bytes, one pass a gram size."""
        padded = [f" {' '.join(t.split())} ".encode() for t in texts]
        size = np.fromiter(map(len, padded), np.int64, len(padded))
        data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(len(texts)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
        out, h = np.zeros(len(texts) * self.dimension), np.zeros(len(data), np.uint32)
        for n in range(1, max(SIZES) + 1):
            if n > len(data):
                break
            end = len(data) - n + 1
            h[:end] = h[:end] * np.uint32(0x01000193) + data[n - 1 :]
            if n in SIZES:
                whole = np.flatnonzero(left >= n)
                x = mixed(h[whole])
                out += np.bincount(row[whole] * self.dimension + x % np.uint32(self.dimension), np.where(x >> np.uint32(31), 1.0, -1.0), len(out))
        out = out.reshape(len(texts), self.dimension).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def mixed(h: np.ndarray) -> np.ndarray:
    """32-bit hashes whose bits all depend on all of h."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def embed(df: DataFrame, text: str, provider: EmbeddingProvider, prefix: str = "") -> DataFrame:
    """Adds vec array<float>: the provider's vector of prefix + text, batch by batch."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [provider.encode([prefix + (t or "") for t in texts[i : i + 1024]]) for i in range(0, len(texts), 1024)]
            yield pd.Series([row for p in parts for row in p])

    return df.withColumn("vec", encode(F.col(text)))


def hashed_grams(df: DataFrame, text: str, dimension: int = 256) -> DataFrame:
    return embed(df, text, HashedGrams(dimension))


# -- grams beside the vectors ------------------------------------------------------------------------------------------------------

#: Grams kept, weight of the grams beside the vector in the models of relevance and of intent.
STRUCTURAL = 30_000
RELEVANCE_WEIGHT, INTENT_WEIGHT = 0.35, 1.25


def structural(corpus: DataFrame, text: str, features: int = STRUCTURAL) -> PipelineModel:
    """Fits tf-idf of character grams on a corpus of labelled phrases; the model gives sparse unit vectors in column `structural`.

    It runs in the JVM. A gram that a phrase repeats counts once, which for short phrases is nearly the damped count.
    """
    grams = corpus.select(char_grams(F.col(text)).alias("_grams"))
    counted = CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=features, minDF=1, binary=True).fit(grams)
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counted.transform(grams)).idf.toArray()
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="_counts", outputCol="_scaled")
    return PipelineModel([counted, scaled, Normalizer(p=2.0, inputCol="_scaled", outputCol="structural")])


def with_structure(df: DataFrame, model: PipelineModel, text: str, weights: dict[str, float], vec: str = "vec") -> DataFrame:
    """Adds, for each name in weights, the vector followed by the structural one times the weight."""
    names = df.columns
    df = model.transform(df.withColumns({"_grams": char_grams(F.col(text)), "_dense": array_to_vector(F.col(vec))}))
    size = len(model.stages[0].vocabulary)
    for name, weight in weights.items():
        df = ElementwiseProduct(scalingVec=Vectors.dense([weight] * size), inputCol="structural", outputCol="_weighted").transform(df)
        df = VectorAssembler(inputCols=["_dense", "_weighted"], outputCol=name).transform(df).drop("_weighted")
    return df.select(*names, *weights)
