"""Clusters: assignment, names, summaries, audits and decisions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_column, hits, in_sample, rounded
from ..sources.written import written
from .decide import Settings


#: Terms that a task holds before it passes their sums on.
HELD = 500_000


def products(vectors: pd.Series, matrix: np.ndarray) -> np.ndarray:
    """Inner products of a batch of vectors with the rows of a matrix, in double precision."""
    return np.stack(vectors.to_numpy()).astype(np.float64) @ matrix.T if len(vectors) else np.zeros((0, len(matrix)))


def best_similarity(vec: Column | str, seeds: list) -> Column:
    """Largest inner product with a seed; 0 without seeds. Seeds are a short configured list, which goes to the workers as one matrix."""
    if not len(seeds):
        return F.lit(0.0)
    matrix = np.array(seeds, np.float64)

    @F.pandas_udf("double")
    def best(vectors: pd.Series) -> pd.Series:
        return pd.Series(products(vectors, matrix).max(axis=1))

    return best(as_column(vec))


def assign(df: DataFrame, centroids: dict[str, list], vec: str = "vec") -> DataFrame:
    """Adds cluster and similarity: the centroid with the largest inner product, the first by name among equals."""
    names = np.array(sorted(centroids))
    matrix = np.array([centroids[n] for n in names], np.float64)

    @F.pandas_udf("cluster string, similarity double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        scores = products(vectors, matrix)
        at = scores.argmax(axis=1)
        return pd.DataFrame({"cluster": names[at], "similarity": scores[np.arange(len(at)), at]})

    return df.withColumn("_b", best(F.col(vec))).withColumns({"cluster": F.col("_b.cluster"), "similarity": F.col("_b.similarity")}).drop("_b")


def cluster_count(rows: int) -> int:
    """Clusters of a sample: half its size's root, between 2 and 80, no more than rows."""
    return min(max(2, int((rows / 2) ** 0.5)), 80, rows)


def summary(df: DataFrame, examples: int = 8) -> DataFrame:
    """Per intent and cluster: phrases, volume, mean confidence and membership, examples by volume."""
    w = Window.partitionBy("intent", "cluster").orderBy(F.desc("search_volume"), F.desc("cluster_probability"), F.desc("occurrences"), "source_row")
    heads = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples)
    listed = heads.groupBy("intent", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "phrase"))), lambda x: x["phrase"]), "\n").alias("representatives"))
    sums = df.groupBy("intent", "cluster").agg(
        F.count("*").alias("phrases"),
        F.sum("search_volume").alias("total_search_volume"),
        F.avg("confidence").alias("average_confidence"),
        F.avg("cluster_probability").alias("average_cluster_probability"),
    )
    return sums.join(listed, ["intent", "cluster"])


def summary_by_parts(df: DataFrame, part: str = "part", legacy: bool = False) -> DataFrame:
    """The summary of a run in parts: sums of sums; means over all rows, or the unweighted mean of the parts' means with `legacy`."""
    parts = df.groupBy(part, "intent", "cluster").agg(
        F.count("*").alias("n"), F.sum("search_volume").alias("v"), F.sum("confidence").alias("c"), F.sum("p_garbage").alias("g")
    )
    mean = (lambda x: F.avg(F.col(x) / F.col("n"))) if legacy else (lambda x: F.sum(x) / F.sum("n"))
    return parts.groupBy("intent", "cluster").agg(
        F.sum("n").alias("phrases"), F.sum("v").alias("total_search_volume"), mean("c").alias("average_confidence"), mean("g").alias("average_garbage_probability")
    )


def outlier_thresholds(df: DataFrame, divisor: int = 20) -> DataFrame:
    """Per relevant cluster: the 5 % quantile of membership and the 90 % quantile of garbage probability on a fixed hash sample; of all rows where the sample has none.

    Quantiles of all rows are taken of clusters without sampled rows alone, and those are small.
    """
    key = ["intent", "cluster"]
    rows = df.where("intent <> 'garbage' and cluster <> 'Unclustered'")
    quantiles = [F.percentile("cluster_probability", F.lit(0.05)).alias("membership_max"), F.percentile("p_garbage", F.lit(0.90)).alias("garbage_min")]
    sampled = rows.where(in_sample("phrase", divisor)).groupBy(*key).agg(*quantiles).where("membership_max is not null and garbage_min is not null")
    rest = rows.join(F.broadcast(sampled.select(*key)), key, "left_anti").groupBy(*key)
    filled = lambda name, q: F.coalesce(F.percentile(F.when(in_sample("phrase", divisor), F.col(name)), F.lit(q)), F.percentile(name, F.lit(q)))
    return sampled.unionByName(rest.agg(filled("cluster_probability", 0.05).alias("membership_max"), filled("p_garbage", 0.90).alias("garbage_min")))


def audit(df: DataFrame) -> DataFrame:
    """Representatives of each relevant cluster by role; (id, intent, cluster, role, phrase, review_id).

    Two centres, the highest volume, the highest garbage risk and the boundary; a phrase keeps its first role, five a cluster at most.
    Each role is a ranking of its own with a bound, so tasks pass on their first rows alone and no cluster is sorted whole.
    """
    rows = df.where("intent <> 'garbage' and cluster <> 'Unclustered'")
    key = ["intent", "cluster"]
    one = rows.groupBy(*key, "phrase").agg(F.min(F.struct("source_row", "cluster_probability", "search_volume", "p_garbage")).alias("x")).select(*key, "phrase", "x.*")
    one = written(one, "representatives")
    first = lambda place, n, order: one.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order, "source_row"))).where(F.col("_n") <= n).select(*key, "phrase", F.lit(place).alias("place"))
    roles = [first(1, 2, F.desc("cluster_probability")), first(2, 1, F.desc("search_volume")), first(3, 1, F.desc("p_garbage")), first(4, 1, F.col("cluster_probability"))]
    chosen = reduce(DataFrame.unionByName, roles).groupBy(*key, "phrase").agg(F.min("place").alias("place"))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    # Clusters are few (80 an intent): numbering them is one small window.
    ids = sizes.withColumn("id", F.format_string("RC%04d", F.row_number().over(Window.orderBy(F.desc("n"), *key))))
    names = F.element_at(F.array(*map(F.lit, ("cluster_center", "high_volume", "relevance_risk", "cluster_boundary"))), F.col("place"))
    suffix = F.when(F.col("place") == 3, "-R").when(F.col("place") == 4, "-B")
    return chosen.join(ids, key).select("id", *key, names.alias("role"), "phrase", F.concat("id", suffix).alias("review_id"))


def lookup(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds the decision of each row's cluster, relevant by default. Decisions are few: 80 clusters an intent at most."""
    return df.join(F.broadcast(decisions.select("intent", "cluster", "decision")), ["intent", "cluster"], "left").withColumn("decision", F.coalesce("decision", F.lit("relevant")))


def outlier_candidates(df: DataFrame, decisions: DataFrame, thresholds: DataFrame, exact: DataFrame) -> DataFrame:
    """Quarantined rows of relevant clusters at the cluster's edge and near garbage that have no exact label; exact: (normalized, outlier_label)."""
    rows = lookup(df, decisions).join(F.broadcast(thresholds), ["intent", "cluster"], "left").join(exact, "normalized", "left")
    edge = (F.col("cluster_probability") <= F.coalesce("membership_max", F.lit(float("-inf")))) & (F.col("p_garbage") >= F.coalesce("garbage_min", F.lit(float("inf"))))
    return rows.where((F.col("decision") == "relevant") & F.col("quarantined") & edge & F.col("outlier_label").isNull())


def apply_decisions(df: DataFrame, decisions: DataFrame, exact: DataFrame, learned: DataFrame) -> DataFrame:
    """Adds final_intent and final_basis; intent itself stays, so applying other decisions later starts from the same rows.

    learned: (source_row) of rows that the outlier model calls garbage.
    """
    rows = lookup(df, decisions).join(exact, "normalized", "left").join(learned.select("source_row", F.lit(True).alias("_learned")), "source_row", "left")
    cluster_garbage = F.col("decision") == "garbage"
    exact_garbage = F.coalesce(F.col("outlier_label") == "garbage", F.lit(False)) & ~cluster_garbage
    learned_garbage = F.coalesce("_learned", F.lit(False)) & ~cluster_garbage & F.col("outlier_label").isNull()
    basis = F.when(cluster_garbage, "Cluster audit").when(exact_garbage, "Outlier label").when(learned_garbage, "Outlier classifier").otherwise("Classifier")
    return rows.withColumns({"final_intent": F.when(cluster_garbage | exact_garbage | learned_garbage, "garbage").otherwise(F.col("intent")), "final_basis": basis, "needs_review": (F.col("decision") == "mixed") & ~exact_garbage & ~learned_garbage}).drop("_learned")


def family_audit(df: DataFrame, s: Settings) -> DataFrame:
    """Per reviewed family: matches, intents, the share of expected intents before families applied, conflicts, status and examples.

    Rules are a short list on the driver: each row finds its rules by expressions, without a join.
    """
    rules = s.family_rules()
    found = F.array_compact(F.array(*[F.when(hits("normalized", [p]), F.struct(F.lit(p).alias("family"), F.lit(x).alias("decision"))) for p, x in rules.items()]))
    rows = df.withColumn("_f", F.explode(found)).select("*", "_f.family", F.col("_f.decision").alias("reviewed_decision"))
    count = lambda test: F.count_if(test)
    sums = rows.groupBy("family", "reviewed_decision").agg(
        F.count("*").alias("matched_rows"),
        *(count(F.col("intent") == x).alias(x) for x in ("commercial", "informational", "garbage")),
        count(F.col("pre_family_intent") == "commercial").alias("pre_commercial"),
        count(F.col("pre_family_intent") == "informational").alias("pre_informational"),
        count(F.col("family_conflict")).alias("conflicts"),
        count(F.col("family_override")).alias("overrides"),
    )
    first = rows.groupBy("family", "phrase").agg(F.min("source_row").alias("source_row"))
    w = Window.partitionBy("family").orderBy("source_row")
    heads = first.withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    examples = heads.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "phrase"))), lambda x: x["phrase"]), " | ").alias("examples"))
    own = F.when(F.col("reviewed_decision") == "commercial", F.col("pre_commercial")).when(F.col("reviewed_decision") == "informational", F.col("pre_informational"))
    seen = F.col("pre_commercial") + F.col("pre_informational")
    share = own / F.greatest(seen, F.lit(1))
    status = F.when(own.isNull(), "neutral_observation").when((seen > 0) & (share >= 0.70) & (F.col("conflicts") / F.greatest("matched_rows", F.lit(1)) <= 0.10), "pass").otherwise("review")
    return sums.join(examples, "family").withColumns({"expected_share": rounded(share, 6), "status": status})


def grams_of(phrase: str, stops: frozenset[str]) -> Counter:
    """Words of two characters and more that are no stop words, and pairs of neighbours among them, with their counts."""
    words = [w for w in phrase.split(" ") if len(w) >= 2 and w not in stops]
    return Counter(chain(words, map(" ".join, zip(words, words[1:], strict=False))))


def names(df: DataFrame, stop_words: tuple[str, ...] = (), features: int = 300, terms: int = 3) -> DataFrame:
    """(intent, cluster, name): the words and word pairs with the largest mean tf-idf in the cluster, its own phrases as the corpus.

    Tasks count their own phrases, one after another, and pass on sums a cluster and term; phrases themselves are never dealt by term, and
    a very long one costs no more than its length. The terms kept are `features` a cluster at most, and clusters are few, so they go to all tasks.
    """
    key = ["intent", "cluster"]
    stops = frozenset(stop_words)
    rows = written(df.where("cluster <> 'Unclustered'").select(*key, "normalized"), "names")

    def sums(worker: Callable[[tuple[str, str], str], Iterable[tuple[str, tuple]]], columns: list[str], kinds: list[pa.DataType]):
        """A function over batches (intent, cluster, normalized) that adds up what the worker gives for a phrase, term by term."""

        def table(total):
            fields = list(zip(*((*own, t, *v) for own, terms in total.items() for t, v in terms.items()), strict=True)) or [[] for _ in columns]
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, kinds, strict=True)], columns)

        def run(batches):
            total: dict[tuple, dict[str, list]] = {}
            for batch in batches:
                for own, phrase in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                    of = total.setdefault(own, {})
                    for term, values in worker(own, phrase or ""):
                        at = of.get(term)
                        if at is None:
                            of[term] = list(values)
                        else:
                            for k, x in enumerate(values):
                                at[k] += x
                if sum(map(len, total.values())) > HELD:
                    yield table(total)
                    total = {}
            yield table(total)

        return run

    text = [pa.string()] * 3
    count = sums(lambda own, phrase: ((t, (1, n)) for t, n in grams_of(phrase, stops).items()), [*key, "term", "df", "total"], [*text, pa.int64(), pa.int64()])
    counts = rows.mapInArrow(count, "intent string, cluster string, term string, df bigint, total bigint").groupBy(*key, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    top = counts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("total"), "term"))).where(F.col("_n") <= features)
    sizes = {(r["intent"], r["cluster"]): r["n"] for r in rows.groupBy(*key).agg(F.count("*").alias("n")).collect()}
    kept: dict[tuple, dict[str, float]] = {own: {} for own in sizes}
    for r in top.collect():
        kept[r["intent"], r["cluster"]][r["term"]] = math.log((1 + sizes[r["intent"], r["cluster"]]) / (1 + r["df"])) + 1
    shared = df.sparkSession.sparkContext.broadcast(kept)

    def weights(own, phrase):
        idf = shared.value[own]
        found = [(t, n * idf[t]) for t, n in grams_of(phrase, stops).items() if t in idf]
        norm = math.sqrt(sum(w * w for _, w in found))
        return ((t, (w / norm,)) for t, w in found)

    share = sums(weights, [*key, "term", "s"], [*text, pa.float64()])
    n = df.sparkSession.createDataFrame([(*own, k) for own, k in sizes.items()], "intent string, cluster string, n bigint")
    means = rows.mapInArrow(share, "intent string, cluster string, term string, s double").groupBy(*key, "term").agg(F.sum("s").alias("s")).join(F.broadcast(n), key).withColumn("m", rounded(F.col("s") / F.col("n"), 9))
    best = means.where(F.char_length("term") > 2).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("m"), F.desc("term")))).where(F.col("_n") <= terms)
    return best.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]), " / ").alias("name"))


def compact(df: DataFrame, columns: list[str], probabilities: tuple[str, ...] = ("p_commercial", "p_informational", "p_garbage")) -> DataFrame:
    """The columns of a result table in order, "" where one is missing, probabilities at four decimals."""
    def value(c: str) -> Column:
        if c not in df.columns:
            return F.lit("").alias(c)
        return rounded(c, 4).alias(c) if c in probabilities else F.col(c)

    return df.select(*map(value, columns))
