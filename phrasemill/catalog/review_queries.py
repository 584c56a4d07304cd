"""Queries of the review queues."""

from pyspark.sql import functions as F

from ..functions.text import in_sample, rounded, unit_interval
from ..operators import review as R
from ..sources.written import written
from . import query
from .inputs import DECIDED, SCORED, SETTINGS, decided, h32, r, scored, unit

G = SETTINGS.garbage_threshold
_DOUBT = "(confidence < 0.65 OR cluster = 'Unclustered' OR cluster_probability < 0.35)"


def _bucket(src, reason, place, limit, order, turn):
    return f"(SELECT normalized, source_row, search_volume, intent, {place} AS bucket, '{reason}' AS reason, {turn} AS turn FROM {src} ORDER BY {order + ', ' if order else ''}source_row LIMIT {limit})"


def _queue(with_sql, buckets, limit=300):
    return f"""WITH {with_sql}, b AS ({' UNION ALL '.join('SELECT * FROM ' + x for x in buckets)}),
    rs AS (SELECT normalized, string_agg(reason, ' | ' ORDER BY turn, reason) AS review_reason FROM (SELECT normalized, reason, min(turn) AS turn FROM b GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY bucket, search_volume DESC, source_row) = 1),
    c AS (SELECT * FROM f ORDER BY bucket, search_volume DESC, source_row LIMIT {limit})
    SELECT c.normalized, c.source_row, c.bucket, rs.review_reason, c.intent FROM c JOIN rs ON c.normalized = rs.normalized"""


_PARTS = [
    ("(SELECT * FROM d WHERE quarantined)", "Relevance quarantine", 0, 100, ""),
    (f"(SELECT * FROM rest WHERE {_DOUBT})", "Low confidence, unclustered, or weak cluster", 1, 150, "confidence, cluster_probability, search_volume DESC"),
    ("(SELECT * FROM d WHERE intent = 'garbage')", "Garbage near the topic-relevance boundary", 2, 75, "topic_relevance DESC, search_volume DESC"),
    ("rest", "Topic relevance probability boundary", 2, 100, f"abs(p_garbage - {G}), search_volume DESC"),
    ("rest", "Commercial/informational probability boundary", 3, 75, "abs(p_commercial - p_informational), search_volume DESC"),
    ("(SELECT * FROM rest WHERE weak_without_transaction AND intent = 'commercial')", "Weak question remained commercial", 3, 50, "p_informational - p_commercial DESC, search_volume DESC"),
    ("(SELECT * FROM rest WHERE family_conflict)", "Reviewed family conflicts with stronger evidence", 3, 75, "search_volume DESC"),
    ("(SELECT * FROM rest WHERE abs(policy_adjustment) >= 0.01)", "Topic policy and classifier conflict", 4, 100, "search_volume DESC"),
    ("rest", "High-priority phrase", 5, 50, "search_volume DESC"),
]
_REP = """(SELECT normalized, source_row, search_volume, intent, 6 AS bucket, 'Representative phrase in cluster' AS reason, 9 AS turn FROM (
    SELECT *, count(*) OVER (PARTITION BY intent, cluster) AS sz, row_number() OVER (PARTITION BY intent, cluster ORDER BY search_volume DESC, source_row) AS rr
    FROM rest WHERE cluster <> 'Unclustered') WHERE rr <= 2 ORDER BY sz DESC, intent, cluster, rr LIMIT 50)"""


@query(_queue(f"d AS MATERIALIZED (SELECT * FROM {DECIDED}), rest AS (SELECT * FROM d WHERE intent <> 'garbage' AND NOT quarantined)", [_bucket(*p, k) for k, p in enumerate(_PARTS)] + [_REP]))
def human_review_queue(spark, sf):
    return R.human_review(written(decided(spark, sf), "decided"), G)


def _two(src, reason, place, each, limit, order, turn):
    return _bucket(f"(SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY part ORDER BY {order}, source_row) <= {each})", reason, place, limit, order, turn)


_LARGE = [
    (f"(SELECT * FROM d WHERE {_DOUBT})", "Low confidence, unclustered, or weak cluster", 0, 200, 175, "confidence, search_volume DESC"),
    ("(SELECT * FROM d WHERE intent = 'garbage')", "Garbage near the topic-relevance boundary", 1, 100, 100, "topic_relevance DESC, search_volume DESC"),
    ("d", "Topic relevance probability boundary", 2, 100, 100, f"abs(p_garbage - {G}), search_volume DESC"),
    ("d", "Commercial/informational probability boundary", 3, 75, 75, "abs(p_commercial - p_informational), search_volume DESC"),
    ("d", "High-priority phrase", 4, 75, 75, "search_volume DESC"),
    ("(SELECT * FROM d WHERE cluster <> 'Unclustered' QUALIFY row_number() OVER (PARTITION BY part, intent, cluster ORDER BY search_volume DESC, source_row) = 1)", "Representative phrase in cluster", 5, 75, 75, "search_volume DESC"),
]


@query(_queue(f"d AS MATERIALIZED (SELECT * FROM {DECIDED})", [_two(*p, k) for k, p in enumerate(_LARGE)]))
def large_review_queue(spark, sf):
    return R.large_review(written(decided(spark, sf), "decided"), G)


def decisions(spark, sf):
    """A decision for some of the clusters."""
    return decisions_of(decided(spark, sf, "intent", "cluster"))


def decisions_of(rows):
    pairs = rows.where("intent <> 'garbage'").select("intent", "cluster").distinct()
    h = F.conv(F.substring(F.md5(F.concat("intent", "cluster")), 1, 8), 16, 10).cast("bigint") % 4
    return pairs.withColumn("decision", F.when(h == 0, "garbage").when(h == 1, "mixed").when(h == 2, "relevant")).where("decision is not null")


DECISIONS = f"""(SELECT * FROM (SELECT intent, cluster, CASE {h32("intent||cluster")} % 4 WHEN 0 THEN 'garbage' WHEN 1 THEN 'mixed' WHEN 2 THEN 'relevant' END AS decision
    FROM (SELECT DISTINCT intent, cluster FROM {DECIDED} WHERE intent <> 'garbage')) WHERE decision IS NOT NULL)"""
_MIXED = f"""(SELECT d.intent, d.cluster, normalized, source_row, row_number() OVER (PARTITION BY d.intent, d.cluster ORDER BY p_garbage DESC, confidence, source_row)::INT AS place
    FROM {DECIDED} d JOIN {DECISIONS} c ON d.intent = c.intent AND d.cluster = c.cluster AND c.decision = 'mixed' QUALIFY place <= 3)"""


@query(f"SELECT intent, cluster, source_row, place FROM {_MIXED}")
def mixed_review(spark, sf):
    return R.mixed_review(decided(spark, sf), decisions(spark, sf)).select("intent", "cluster", "source_row", "place")


@query(f"""WITH prior AS (SELECT * FROM {DECIDED} WHERE quarantined), outliers AS (SELECT DISTINCT normalized FROM {DECIDED} WHERE {h32('normalized')} % 9 = 0),
    b AS (SELECT normalized, source_row, 0 AS turn FROM {_MIXED} UNION ALL SELECT p.normalized, p.source_row, 1 FROM prior p
        LEFT JOIN {DECISIONS} c ON p.intent = c.intent AND p.cluster = c.cluster
        WHERE coalesce(c.decision, 'relevant') = 'relevant' AND p.normalized NOT IN (SELECT normalized FROM outliers))
    SELECT normalized, turn, source_row FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY turn, source_row) = 1) ORDER BY turn, source_row LIMIT 300""")
def post_audit_review(spark, sf):
    # Read four times.
    d = written(decided(spark, sf, "normalized", "source_row", "intent", "cluster", "p_garbage", "confidence", "quarantined"), "decided")
    c = decisions_of(d)
    outliers = d.where(in_sample("normalized", 9)).select("normalized").distinct()
    return R.post_audit(R.mixed_review(d, c), d.where("quarantined"), c, outliers)


@query(f"SELECT normalized, string_agg(reason, ' | ' ORDER BY k) AS reasons FROM (SELECT normalized, reason, min(k) AS k FROM (SELECT normalized, intent AS reason, 1 AS k FROM {DECIDED} UNION ALL SELECT normalized, cluster, 2 FROM {DECIDED}) GROUP BY 1, 2) GROUP BY 1")
def review_reasons(spark, sf):
    d = decided(spark, sf)
    rows = d.select("normalized", F.col("intent").alias("reason"), F.lit(1).alias("k")).unionByName(d.select("normalized", F.col("cluster").alias("reason"), F.lit(2).alias("k")))
    first = rows.groupBy("normalized", "reason").agg(F.min("k").alias("k"))
    return first.groupBy("normalized").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "reason"))), lambda x: x["reason"]), " | ").alias("reasons"))


@query(f"SELECT normalized, source_row FROM {DECIDED} WHERE quarantined AND normalized NOT IN (SELECT normalized FROM {DECIDED} WHERE cluster = 'c1')")
def anti_seen(spark, sf):
    d = decided(spark, sf)
    return d.where("quarantined").join(d.where("cluster = 'c1'").select("normalized"), "normalized", "left_anti").select("normalized", "source_row")


@query(f"SELECT normalized, source_row, intent, NULL::VARCHAR AS note FROM {DECIDED} WHERE quarantined UNION ALL SELECT normalized, source_row, NULL, 'unclustered' FROM {DECIDED} WHERE cluster = 'Unclustered'")
def union_review(spark, sf):
    d = decided(spark, sf)
    a = d.where("quarantined").select("normalized", "source_row", "intent")
    b = d.where("cluster = 'Unclustered'").select("normalized", "source_row", F.lit("unclustered").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


_ACTIVE = f"(SELECT source_row, normalized, search_volume, pg, c, i, is_ > 0.8 AS conflict, [pg, (1.0-pg)*c, (1.0-pg)*i] AS p FROM {SCORED})"


@query(f"""SELECT source_row, conflict, {r('m')} AS margin FROM (SELECT *, list_sort(p)[3] - list_sort(p)[2] AS m,
    -(0.0 + p[1]*ln(greatest(p[1],1e-12)) + p[2]*ln(greatest(p[2],1e-12)) + p[3]*ln(greatest(p[3],1e-12))) AS e FROM {_ACTIVE})
    ORDER BY conflict DESC, m, e DESC, search_volume DESC, source_row LIMIT 200""")
def active_review_rank(spark, sf):
    s = scored(spark, sf)
    rows = s.withColumns({"conflict": F.col("is_") > 0.8, "p": F.array("pg", (1.0 - F.col("pg")) * F.col("c"), (1.0 - F.col("pg")) * F.col("i"))})
    return R.active_rank(rows, 200).select("source_row", "conflict", rounded("margin", 6).alias("margin"))


@query(f"SELECT source_row, {r('abs(c-i)')} AS margin FROM {SCORED} ORDER BY abs(c-i), search_volume DESC, len(string_split(normalized,' ')), source_row LIMIT 200")
def intent_review_rank(spark, sf):
    return R.intent_rank(scored(spark, sf), 200).select("source_row", rounded("margin", 6).alias("margin"))


@query(f"""SELECT source_row, {r('0.55*pg + 0.35*cs + 0.10*(CASE WHEN mx > 0 THEN ln(1+search_volume)/greatest(mx,1.0) ELSE 0.0 END)')} AS score
    FROM {SCORED}, (SELECT max(ln(1+search_volume)) AS mx FROM {SCORED})""")
def relevance_score(spark, sf):
    return R.relevance_score(scored(spark, sf).withColumnRenamed("cs", "novelty")).select("source_row", rounded("score", 6).alias("score"))


_W = "(weak_question AND NOT commercial_marker AND NOT informational_marker AND NOT commercial_family AND NOT informational_family)"
_POL = f"(SELECT *, {unit('normalized', 'q')} AS q FROM {DECIDED})"


@query(f"""WITH a AS (SELECT *, CASE WHEN q >= 0.5 THEN 'commercial' ELSE 'informational' END AS predicted, greatest(q, 1-q) AS certainty, abs(2*q-1) AS margin,
        commercial_marker AS cm, informational_marker AS im, commercial_family AS fc, informational_family AS fi, {_W} AS weak FROM {_POL}),
    b AS (SELECT *, predicted = 'commercial' AS com, (im AND NOT cm AND predicted = 'commercial') OR (cm AND NOT im AND predicted = 'informational') OR (cm AND im)
        OR (fi AND predicted = 'commercial') OR (fc AND predicted = 'informational') OR (fi AND fc) OR (fi AND cm) OR (fc AND im) AS conflict FROM a),
    c AS (SELECT *, CASE WHEN weak THEN 'weak_question_context_audit' WHEN fc AND fi THEN 'opposite_family_conflict'
        WHEN (fi AND cm) OR (fc AND im) THEN 'family_strong_signal_conflict' WHEN (fi AND com) OR (fc AND NOT com) THEN 'family_classifier_disagreement'
        WHEN cm AND im THEN 'strong_signal_conflict' WHEN conflict THEN 'signal_classifier_disagreement' ELSE 'intent_boundary_fallback' END AS reason FROM b),
    w AS (SELECT *, 0 AS turn, row_number() OVER (ORDER BY com DESC, certainty DESC, source_row) AS k FROM c WHERE weak QUALIFY k <= 25),
    x AS (SELECT *, 1 AS turn, row_number() OVER (ORDER BY certainty DESC, source_row) AS k FROM c WHERE conflict AND source_row NOT IN (SELECT source_row FROM w)),
    y AS (SELECT *, 2 AS turn, row_number() OVER (ORDER BY margin, source_row) AS k FROM c WHERE NOT conflict AND source_row NOT IN (SELECT source_row FROM w))
    SELECT source_row, predicted, reason FROM (SELECT * FROM w UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y) ORDER BY turn, k LIMIT 50""")
def policy_conflict_review(spark, sf):
    q = unit_interval("normalized", "q")
    flags = ("commercial_marker", "informational_marker", "commercial_family", "informational_family", "weak_question")
    # Read three times.
    rows = written(decided(spark, sf, "normalized", "source_row", *flags).withColumn("q", q).drop("normalized"), "decided")
    rows = rows.withColumns({"predicted": F.when(F.col("q") >= 0.5, "commercial").otherwise("informational"), "certainty": F.greatest("q", 1 - F.col("q")), "margin": F.abs(2 * F.col("q") - 1)})
    return R.policy_conflicts(rows, 50).select("source_row", "predicted", "reason")


@query()
def relevance_review(spark, sf):
    from ..operators.features import hashed_grams
    from ..operators.phrases import hash_sample

    rows = R.relevance_score(scored(spark, sf).withColumnRenamed("cs", "novelty"))
    first = rows.groupBy("normalized").agg(F.min_by(F.struct("source_row", "pg", "novelty", "score"), "source_row").alias("x")).select("normalized", "x.*")
    # The two ranked quotas are taken over all phrases, the diverse rest from a pool.
    pool = hash_sample(first, 800, "normalized").unionByName(R.relevance_heads(first, 50)).dropDuplicates(["source_row"])
    return R.farthest_first(hashed_grams(pool, "normalized"), 50)
