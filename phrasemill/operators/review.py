"""Review queues. Each bucket is a distributed top-k; only the bounded union of the buckets meets in one window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a queue, thresholds of doubt.
QUEUE = 300
LOW_CONFIDENCE, WEAK_CLUSTER = 0.65, 0.35


def doubtful() -> Column:
    return (F.col("confidence") < LOW_CONFIDENCE) | (F.col("cluster") == "Unclustered") | (F.col("cluster_probability") < WEAK_CLUSTER)


def bucket(df: DataFrame, reason: str, place: int, limit: int, *order) -> DataFrame:
    """The first `limit` rows in an order, ties by source_row, marked with reason and place."""
    return df.orderBy(*order, "source_row").limit(limit).withColumns({"reason": F.lit(reason), "bucket": F.lit(place)})


def representatives(df: DataFrame, each: int, limit: int) -> DataFrame:
    """The `each` rows of largest volume of every cluster, largest clusters first, at most `limit` rows."""
    named = df.where("cluster <> 'Unclustered'")
    w = Window.partitionBy("intent", "cluster").orderBy(F.desc("search_volume"), "source_row")
    best = named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each)
    sizes = named.groupBy("intent", "cluster").agg(F.count("*").alias("_size"))
    return best.join(sizes, ["intent", "cluster"]).orderBy(F.desc("_size"), "intent", "cluster", "_r").limit(limit).drop("_r", "_size")


def queue(parts: list[DataFrame], limit: int = QUEUE, volume_first: bool = True) -> DataFrame:
    """One row a phrase: its first bucket decides the place; reasons are joined in the order of the buckets."""
    rows = reduce(DataFrame.unionByName, parts).select("normalized", "source_row", "search_volume", "bucket", "reason", "intent")
    order = [F.col("bucket"), F.desc("search_volume"), F.col("source_row")] if volume_first else [F.col("bucket"), F.col("source_row")]
    # `turn` numbers the buckets as they were given: two buckets of one place keep their order in the reasons.
    turn = F.min("turn").alias("turn")
    marked = reduce(DataFrame.unionByName, [p.select("normalized", "reason").withColumn("turn", F.lit(i)) for i, p in enumerate(parts)])
    reasons = marked.groupBy("normalized", "reason").agg(turn).groupBy("normalized").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "reason"))), lambda x: x["reason"]), " | ").alias("review_reason"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("normalized").orderBy(*order))).where("_n = 1")
    chosen = first.orderBy(*order).limit(limit)
    return chosen.join(reasons, "normalized").select("normalized", "source_row", "bucket", "review_reason", "intent")


def human_review(decided: DataFrame, garbage_threshold: float) -> DataFrame:
    """The standard queue: doubt, boundaries, conflicts, volume and cluster representatives."""
    col, volume = F.col, F.desc("search_volume")
    quarantined = decided.where("quarantined")
    garbage = decided.where("intent = 'garbage'")
    rest = decided.where("intent <> 'garbage' and not quarantined")
    parts = [
        bucket(quarantined, "Relevance quarantine", 0, 100),
        bucket(rest.where(doubtful()), "Low confidence, unclustered, or weak cluster", 1, 150, "confidence", "cluster_probability", volume),
        bucket(garbage, "Garbage near the topic-relevance boundary", 2, 75, F.desc("topic_relevance"), volume),
        bucket(rest, "Topic relevance probability boundary", 2, 100, F.abs(col("p_garbage") - garbage_threshold), volume),
        bucket(rest, "Commercial/informational probability boundary", 3, 75, F.abs(col("p_commercial") - col("p_informational")), volume),
        bucket(rest.where("weak_without_transaction and intent = 'commercial'"), "Weak question remained commercial", 3, 50, F.desc(col("p_informational") - col("p_commercial")), volume),
        bucket(rest.where("family_conflict"), "Reviewed family conflicts with stronger evidence", 3, 75, volume),
        bucket(rest.where(F.abs("policy_adjustment") >= 0.01), "Topic policy and classifier conflict", 4, 100, volume),
        bucket(rest, "High-priority phrase", 5, 50, volume),
        representatives(rest, 2, 50).withColumns({"reason": F.lit("Representative phrase in cluster"), "bucket": F.lit(6)}),
    ]
    return queue(parts)


def large_review(decided: DataFrame, garbage_threshold: float, part: str = "part") -> DataFrame:
    """The queue of chunked runs: limits within each part, then over all parts."""
    col, volume = F.col, F.desc("search_volume")

    def two_level(df: DataFrame, reason: str, place: int, each: int, limit: int, *order) -> DataFrame:
        w = Window.partitionBy(part).orderBy(*order, "source_row")
        return bucket(df.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= each).drop("_p"), reason, place, limit, *order)

    per_cluster = Window.partitionBy(part, "intent", "cluster").orderBy(volume, "source_row")
    heads = decided.where("cluster <> 'Unclustered'").withColumn("_c", F.row_number().over(per_cluster)).where("_c = 1").drop("_c")
    parts = [
        two_level(decided.where(doubtful()), "Low confidence, unclustered, or weak cluster", 0, 200, 175, F.col("confidence"), volume),
        two_level(decided.where("intent = 'garbage'"), "Garbage near the topic-relevance boundary", 1, 100, 100, F.desc("topic_relevance"), volume),
        two_level(decided, "Topic relevance probability boundary", 2, 100, 100, F.abs(col("p_garbage") - garbage_threshold), volume),
        two_level(decided, "Commercial/informational probability boundary", 3, 75, 75, F.abs(col("p_commercial") - col("p_informational")), volume),
        two_level(decided, "High-priority phrase", 4, 75, 75, volume),
        two_level(heads, "Representative phrase in cluster", 5, 75, 75, volume),
    ]
    return queue(parts)


def mixed_review(decided: DataFrame, decisions: DataFrame, each: int = 3) -> DataFrame:
    """Of every cluster decided as mixed, the rows with most garbage probability and least confidence."""
    mixed = decided.join(F.broadcast(decisions.where("decision = 'mixed'").select("intent", "cluster")), ["intent", "cluster"])
    w = Window.partitionBy("intent", "cluster").orderBy(F.desc("p_garbage"), "confidence", "source_row")
    return mixed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)


def post_audit(mixed: DataFrame, prior: DataFrame, decisions: DataFrame, outliers: DataFrame, limit: int = QUEUE) -> DataFrame:
    """After the cluster audit: mixed samples first, then earlier rows of relevant clusters that are no outliers; one row a phrase."""
    decided = prior.join(F.broadcast(decisions), ["intent", "cluster"], "left").where(F.coalesce("decision", F.lit("relevant")) == "relevant")
    left = decided.join(outliers.select("normalized"), "normalized", "left_anti")
    both = mixed.select("normalized", "source_row").withColumn("turn", F.lit(0)).unionByName(left.select("normalized", "source_row").withColumn("turn", F.lit(1)))
    first = both.groupBy("normalized").agg(F.min(F.struct("turn", "source_row")).alias("x")).select("normalized", "x.turn", "x.source_row")
    return first.orderBy("turn", "source_row").limit(limit)


def active_rank(scored: DataFrame, limit: int) -> DataFrame:
    """Unlabelled rows by label conflict among neighbours, margin, entropy and volume. Columns p (array of class probabilities), conflict."""
    ordered = F.array_sort("p")
    margin = F.element_at(ordered, -1) - F.element_at(ordered, -2)
    entropy = -F.aggregate("p", F.lit(0.0), lambda s, x: s + x * F.ln(F.greatest(x, F.lit(1e-12))))
    ranked = scored.withColumns({"margin": margin, "entropy": entropy})
    return ranked.orderBy(F.desc("conflict"), "margin", F.desc("entropy"), F.desc("search_volume"), "source_row").limit(limit)


def intent_rank(scored: DataFrame, limit: int) -> DataFrame:
    """Rows nearest to the boundary of the intents, then of large volume, then short."""
    ranked = scored.withColumn("margin", F.abs(F.col("c") - F.col("i")))
    return ranked.orderBy("margin", F.desc("search_volume"), F.size(F.split("normalized", " ")), "source_row").limit(limit)


def relevance_score(scored: DataFrame) -> DataFrame:
    """0.55 of the garbage probability, 0.35 of novelty, 0.10 of the volume on a log scale of the largest."""
    most = scored.agg(F.max(F.log1p("search_volume")).alias("_most"))
    with_most = scored.join(F.broadcast(most))
    priority = F.when(F.col("_most") > 0, F.log1p("search_volume") / F.greatest("_most", F.lit(1.0))).otherwise(0.0)
    return with_most.withColumn("score", 0.55 * F.col("pg") + 0.35 * F.col("novelty") + 0.10 * priority).drop("_most")


def policy_conflicts(decided: DataFrame, limit: int) -> DataFrame:
    """Weak questions without other evidence first, then conflicts of signals and classifier, then the boundary; with the reason of each.

    Columns predicted and certainty hold the classifier's view; the flags are those of the decision.
    """
    col = F.col
    cm, im, fc, fi, wq = (col(x) for x in ("commercial_marker", "informational_marker", "commercial_family", "informational_family", "weak_question"))
    com, inf = col("predicted") == "commercial", col("predicted") == "informational"
    weak = wq & ~cm & ~im & ~fc & ~fi
    conflict = (im & ~cm & com) | (cm & ~im & inf) | (cm & im) | (fi & com) | (fc & inf) | (fi & fc) | (fi & cm) | (fc & im)
    reason = (
        F.when(weak, "weak_question_context_audit")
        .when(fc & fi, "opposite_family_conflict")
        .when((fi & cm) | (fc & im), "family_strong_signal_conflict")
        .when((fi & com) | (fc & inf), "family_classifier_disagreement")
        .when(cm & im, "strong_signal_conflict")
        .when(conflict, "signal_classifier_disagreement")
        .otherwise("intent_boundary_fallback")
    )
    rows = decided.withColumns({"weak": weak, "conflict": conflict, "reason": reason})
    first = rows.where("weak").orderBy(F.when(com, 0).otherwise(1), F.desc("certainty"), "source_row").limit(min(limit, max(10, limit // 2)))
    then = rows.where("conflict and not weak").orderBy(F.desc("certainty"), "source_row").limit(limit)
    last = rows.where("not conflict").orderBy("margin", "source_row").limit(2 * limit)
    every = [p.withColumn("turn", F.lit(i)) for i, p in enumerate((first, then, last))]
    key = [F.when(com, 0).otherwise(1) * (col("turn") == 0).cast("int"), F.when(col("turn") == 2, col("margin")).otherwise(-col("certainty"))]
    union = reduce(DataFrame.unionByName, every)
    once = union.withColumn("_n", F.row_number().over(Window.partitionBy("source_row").orderBy("turn"))).where("_n = 1")
    return once.orderBy("turn", *key, "source_row").limit(limit)


def relevance_heads(rows: DataFrame, limit: int) -> DataFrame:
    """The rows that the ranked quotas of farthest_first() want: of the highest garbage probability and of the highest novelty, by distributed top-k."""
    head = lambda name, n: rows.orderBy(F.desc(name), "source_row").limit(n)
    return head("pg", max(1, limit // 3)).unionByName(head("novelty", max(1, limit // 3) + max(1, limit // 4)))


def farthest_first(rows: DataFrame, limit: int) -> DataFrame:
    """The relevance review: a third by garbage probability, a quarter by novelty, the rest greedily farthest from those chosen.

    rows: (source_row, pg, novelty, score, vec), 800 at most by the caller's sampling, which one task orders.
    """
    import numpy as np
    import pandas as pd

    def choose(batches):
        got = [b for b in batches if len(b)]
        if not got:
            return
        df = pd.concat(got, ignore_index=True).sort_values("source_row", ignore_index=True)
        x = np.stack(df["vec"].to_numpy())
        chosen: dict[int, str] = {}

        def add(order, reason, quota):
            for k in order[:quota]:
                chosen.setdefault(int(k), reason)

        if df["pg"].max() > 0:
            add(np.argsort(-df["pg"].to_numpy(), kind="stable"), "garbage_model_candidate", max(1, limit // 3))
        add(np.argsort(-df["novelty"].to_numpy(), kind="stable"), "semantic_outlier_candidate", max(1, limit // 4))
        near = (x @ x[list(chosen)].T).max(axis=1) if chosen else 1 - df["novelty"].to_numpy()
        while len(chosen) < min(limit, len(df)):
            gain = 0.75 * (1 - near) + 0.25 * df["score"].to_numpy()
            gain[list(chosen)] = -np.inf
            k = int(gain.argmax())
            chosen[k] = "diverse_candidate"
            near = np.maximum(near, x @ x[k])
        keep = df.iloc[list(chosen)]
        yield pd.DataFrame({"source_row": keep["source_row"], "reason": list(chosen.values()), "place": range(len(chosen))})

    return rows.coalesce(1).mapInPandas(choose, "source_row bigint, reason string, place bigint")
