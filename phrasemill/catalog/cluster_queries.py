"""Queries of clusters, summaries, audits and result tables."""

from pyspark.sql import functions as F

from ..functions.text import hash32, rounded
from ..operators import clusters as C
from ..sources.written import written
from . import query
from .inputs import DECIDED, SETTINGS, decided, h32, r, table
from .review_queries import DECISIONS, decisions

CORE = ["phrase", "search_volume", "intent", "cluster", "p_commercial", "p_informational", "p_garbage", "correct_intent", "reviewer_notes"]
GARBAGE = ["phrase", "search_volume", "p_commercial", "p_informational", "p_garbage"]
REVIEW = ["phrase", "search_volume", "intent", "cluster", "p_commercial", "p_informational", "p_garbage", "correct_intent", "correct_cluster", "reviewer_notes"]


def _cols(columns):
    return ", ".join(f"{r(c, 4)} AS {c}" if c.startswith("p_") else f"'' AS {c}" if c.startswith(("correct_", "reviewer_")) else c for c in columns)


@query(f"SELECT {_cols(CORE)} FROM {DECIDED} WHERE intent <> 'garbage'")
def compact_core(spark, sf):
    return C.compact(decided(spark, sf).where("intent <> 'garbage'"), CORE)


@query(f"SELECT {_cols(GARBAGE)} FROM {DECIDED} WHERE intent = 'garbage'")
def compact_garbage(spark, sf):
    return C.compact(decided(spark, sf).where("intent = 'garbage'"), GARBAGE)


@query(f"SELECT {_cols(REVIEW)} FROM {DECIDED} WHERE quarantined")
def compact_review(spark, sf):
    return C.compact(decided(spark, sf).where("quarantined"), REVIEW)


@query(f"SELECT intent, count(*) AS n FROM {DECIDED} GROUP BY intent")
def intent_counts(spark, sf):
    return decided(spark, sf).groupBy("intent").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT * FROM {DECIDED} WHERE intent <> 'garbage'),
    h AS (SELECT *, row_number() OVER (PARTITION BY intent, cluster ORDER BY search_volume DESC, cluster_probability DESC, occurrences DESC, source_row) AS k FROM d),
    e AS (SELECT intent, cluster, string_agg(phrase, chr(10) ORDER BY k) AS representatives FROM h WHERE k <= 8 GROUP BY 1, 2)
    SELECT d.intent, d.cluster, count(*) AS phrases, sum(search_volume) AS total_search_volume, {r('avg(confidence)')} AS average_confidence,
        {r('avg(cluster_probability)')} AS average_cluster_probability, any_value(representatives) AS representatives
    FROM d JOIN e ON d.intent = e.intent AND d.cluster = e.cluster GROUP BY 1, 2""")
def cluster_summary(spark, sf):
    s = C.summary(written(decided(spark, sf), "decided").where("intent <> 'garbage'"))
    return s.withColumns({c: rounded(c, 6) for c in ("average_confidence", "average_cluster_probability")})


@query(f"""SELECT intent, cluster, sum(n)::BIGINT AS phrases, sum(v) AS total_search_volume, {r('avg(c)')} AS average_confidence, {r('avg(g)')} AS average_garbage_probability
    FROM (SELECT part, intent, cluster, count(*) AS n, sum(search_volume) AS v, avg(confidence) AS c, avg(p_garbage) AS g FROM {DECIDED} GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def cluster_summary_partial_final(spark, sf):
    s = C.summary_by_parts(decided(spark, sf), legacy=True)
    return s.withColumns({c: rounded(c, 6) for c in ("average_confidence", "average_garbage_probability")})


_REL = f"(SELECT * FROM {DECIDED} WHERE intent <> 'garbage' AND cluster <> 'Unclustered')"
THRESHOLDS = f"""(SELECT intent, cluster, coalesce(quantile_cont(cluster_probability, 0.05) FILTER (WHERE {h32('phrase')} % 20 = 0), quantile_cont(cluster_probability, 0.05)) AS membership_max,
    coalesce(quantile_cont(p_garbage, 0.90) FILTER (WHERE {h32('phrase')} % 20 = 0), quantile_cont(p_garbage, 0.90)) AS garbage_min FROM {_REL} GROUP BY 1, 2)"""


@query(f"SELECT intent, cluster, {r('membership_max')} AS membership_max, {r('garbage_min')} AS garbage_min FROM {THRESHOLDS}")
def cluster_outlier_thresholds(spark, sf):
    return C.outlier_thresholds(written(decided(spark, sf), "decided")).withColumns({c: rounded(c, 6) for c in ("membership_max", "garbage_min")})


_AUDIT = f"""(WITH o AS (SELECT intent, cluster, phrase, min(source_row) AS source_row, arg_min(cluster_probability, source_row) AS cp, arg_min(search_volume, source_row) AS v, arg_min(p_garbage, source_row) AS g FROM {_REL} GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY intent, cluster ORDER BY cp DESC, source_row) AS r1, row_number() OVER (PARTITION BY intent, cluster ORDER BY v DESC, source_row) AS r2,
        row_number() OVER (PARTITION BY intent, cluster ORDER BY g DESC, source_row) AS r3, row_number() OVER (PARTITION BY intent, cluster ORDER BY cp, source_row) AS r4 FROM o),
    p AS (SELECT *, CASE WHEN r1 <= 2 THEN 1 WHEN r2 = 1 THEN 2 WHEN r3 = 1 THEN 3 WHEN r4 = 1 THEN 4 END AS place FROM k),
    n AS (SELECT intent, cluster, printf('RC%04d', row_number() OVER (ORDER BY count(*) DESC, intent, cluster)) AS id FROM {_REL} GROUP BY intent, cluster)
    SELECT n.id, p.intent, p.cluster, ['cluster_center','high_volume','relevance_risk','cluster_boundary'][place] AS role, phrase,
        CASE place WHEN 3 THEN n.id||'-R' WHEN 4 THEN n.id||'-B' END AS review_id
    FROM p JOIN n ON p.intent = n.intent AND p.cluster = n.cluster WHERE place IS NOT NULL)"""


@query(f"SELECT * FROM {_AUDIT}")
def cluster_audit(spark, sf):
    return C.audit(written(decided(spark, sf), "decided"))


def _exact(spark, sf):
    h = hash32(F.concat("normalized", F.lit("e")))
    rows = decided(spark, sf).select("normalized").distinct()
    return rows.where(h % 25 == 0).withColumn("outlier_label", F.when(h % 2 == 0, "garbage").otherwise("relevant"))


_he = h32("normalized||'e'")
EXACT = f"(SELECT normalized, CASE WHEN {_he} % 2 = 0 THEN 'garbage' ELSE 'relevant' END AS outlier_label FROM (SELECT DISTINCT normalized FROM {DECIDED}) WHERE {_he} % 25 = 0)"
_JOINED = f"""(SELECT d.*, coalesce(c.decision, 'relevant') AS decision, t.membership_max, t.garbage_min, e.outlier_label FROM {DECIDED} d
    LEFT JOIN {DECISIONS} c ON d.intent = c.intent AND d.cluster = c.cluster LEFT JOIN {THRESHOLDS} t ON d.intent = t.intent AND d.cluster = t.cluster
    LEFT JOIN {EXACT} e ON d.normalized = e.normalized)"""
_EDGE = "decision = 'relevant' AND quarantined AND cluster_probability <= membership_max + 0.2 AND p_garbage >= garbage_min - 0.05 AND outlier_label IS NULL"


@query(f"SELECT source_row, decision FROM (SELECT d.source_row, coalesce(c.decision, 'relevant') AS decision FROM {DECIDED} d LEFT JOIN {DECISIONS} c ON d.intent = c.intent AND d.cluster = c.cluster)")
def cluster_decision_lookup(spark, sf):
    return C.lookup(decided(spark, sf), decisions(spark, sf)).select("source_row", "decision")


def _candidates(spark, sf):
    """Limits a little wider than the quantiles, so that random scores have candidates."""
    # Read by the thresholds, the decisions and the candidates.
    d = written(decided(spark, sf), "decided")
    wide = C.outlier_thresholds(d).withColumns({"membership_max": F.col("membership_max") + 0.2, "garbage_min": F.col("garbage_min") - 0.05})
    return d, C.outlier_candidates(d, decisions(spark, sf), wide, _exact(spark, sf))


@query(f"SELECT source_row FROM {_JOINED} WHERE {_EDGE}")
def outlier_candidates(spark, sf):
    return _candidates(spark, sf)[1].select("source_row")


@query(f"""SELECT source_row, CASE WHEN decision = 'garbage' OR outlier_label = 'garbage' OR l THEN 'garbage' ELSE intent END AS final_intent,
    CASE WHEN decision = 'garbage' THEN 'Cluster audit' WHEN outlier_label = 'garbage' THEN 'Outlier label' WHEN l THEN 'Outlier classifier' ELSE 'Classifier' END AS final_basis,
    decision = 'mixed' AND NOT coalesce(outlier_label = 'garbage', false) AND NOT l AS needs_review
    FROM (SELECT *, coalesce({_EDGE}, false) AND {h32("normalized||'l'")} % 2 = 0 AS l FROM {_JOINED})""")
def apply_cluster_decisions(spark, sf):
    d, candidates = _candidates(spark, sf)
    learned = candidates.where(hash32(F.concat("normalized", F.lit("l"))) % 2 == 0)
    return C.apply_decisions(d, decisions(spark, sf), _exact(spark, sf), learned).select("source_row", "final_intent", "final_basis", "needs_review")


def _family_audit_sql():
    from ..functions.text import marker_regex

    rules = " UNION ALL ".join(f"SELECT '{p}' AS family, '{x}' AS reviewed_decision, * FROM d WHERE regexp_matches(normalized, '{marker_regex([p])}')" for p, x in SETTINGS.family_rules().items())
    return f"""WITH d AS MATERIALIZED (SELECT * FROM {DECIDED}), m AS ({rules}),
    e AS (SELECT family, string_agg(phrase, ' | ' ORDER BY s) AS examples FROM (SELECT family, phrase, min(source_row) AS s FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY family ORDER BY min(source_row)) <= 3) GROUP BY 1),
    a AS (SELECT family, reviewed_decision, count(*) AS matched_rows, count_if(intent = 'commercial')::BIGINT AS commercial, count_if(intent = 'informational')::BIGINT AS informational, count_if(intent = 'garbage')::BIGINT AS garbage,
        count_if(pre_family_intent = 'commercial')::BIGINT AS pre_commercial, count_if(pre_family_intent = 'informational')::BIGINT AS pre_informational,
        count_if(family_conflict)::BIGINT AS conflicts, count_if(family_override)::BIGINT AS overrides FROM m GROUP BY 1, 2),
    b AS (SELECT *, CASE reviewed_decision WHEN 'commercial' THEN pre_commercial WHEN 'informational' THEN pre_informational END / greatest(pre_commercial + pre_informational, 1) AS share FROM a)
    SELECT b.* EXCLUDE (share), e.examples, {r('share')} AS expected_share, CASE WHEN share IS NULL THEN 'neutral_observation'
        WHEN pre_commercial + pre_informational > 0 AND share >= 0.7 AND conflicts / greatest(matched_rows, 1) <= 0.1 THEN 'pass' ELSE 'review' END AS status
    FROM b JOIN e ON b.family = e.family"""


@query(_family_audit_sql())
def family_audit(spark, sf):
    return C.family_audit(written(decided(spark, sf), "decided"), SETTINGS)


_NAMES = f"""WITH d AS (SELECT intent, cluster, source_row, list_filter(string_split(normalized,' '), lambda t: length(t) >= 2 AND t NOT IN ('the','of')) AS t FROM {DECIDED} WHERE cluster <> 'Unclustered'),
    n AS (SELECT intent, cluster, count(*) AS n FROM d GROUP BY 1, 2),
    x AS (SELECT intent, cluster, source_row, unnest(list_concat(t, list_transform(range(1, len(t)), lambda k: t[k]||' '||t[k+1]))) AS term FROM d),
    tf AS (SELECT intent, cluster, source_row, term, count(*) AS tf FROM x GROUP BY 1, 2, 3, 4),
    df AS (SELECT intent, cluster, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY intent, cluster ORDER BY sum(tf) DESC, term) <= 300),
    w AS (SELECT tf.intent, tf.cluster, tf.source_row, tf.term, n.n, tf*(ln((1.0::DOUBLE+n.n)/(1.0::DOUBLE+df))+1.0) AS w FROM tf JOIN df ON tf.intent = df.intent AND tf.cluster = df.cluster AND tf.term = df.term JOIN n ON tf.intent = n.intent AND tf.cluster = n.cluster),
    l AS (SELECT intent, cluster, source_row, sqrt(sum(w*w)) AS norm FROM w GROUP BY 1, 2, 3),
    m AS (SELECT w.intent, w.cluster, w.term, {r('sum(w/norm)/any_value(w.n)', 9)} AS m FROM w JOIN l ON w.intent = l.intent AND w.cluster = l.cluster AND w.source_row = l.source_row WHERE length(term) > 2 GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY intent, cluster ORDER BY m DESC, term DESC) AS k FROM m QUALIFY k <= 3)
    SELECT intent, cluster, string_agg(term, ' / ' ORDER BY k) AS name FROM b GROUP BY 1, 2"""


@query(_NAMES)
def cluster_names(spark, sf):
    return C.names(written(decided(spark, sf), "decided"), ("the", "of"))


# -- vectors ---------------------------------------------------------------------------------------------------------------


def _seeds(spark, sf):
    """The vector with the lowest id of each label: ten labels."""
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()
    return {f"s{x['label']}": x["v"] for x in rows}


_SEED = "(SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label)"
_SIM = "list_dot_product(e.embedding::DOUBLE[], s.v)"


@query(f"SELECT vec_id, {r(f'max({_SIM})')} AS similarity FROM embeddings e, {_SEED} s GROUP BY vec_id")
def seed_scores(spark, sf):
    seeds = list(_seeds(spark, sf).values())
    return table(spark, sf, "embeddings").select("vec_id", rounded(C.best_similarity("embedding", seeds), 6).alias("similarity"))


@query(f"SELECT vec_id, {r(f'max({_SIM}) FILTER (WHERE s.label < 5)')} AS commercial, {r(f'max({_SIM}) FILTER (WHERE s.label >= 5)')} AS informational FROM embeddings e, {_SEED} s GROUP BY vec_id")
def policy_similarity(spark, sf):
    seeds = _seeds(spark, sf)
    side = lambda f: [v for k, v in sorted(seeds.items()) if f(int(k[1:]))]
    return table(spark, sf, "embeddings").select(
        "vec_id",
        rounded(C.best_similarity("embedding", side(lambda k: k < 5)), 6).alias("commercial"),
        rounded(C.best_similarity("embedding", side(lambda k: k >= 5)), 6).alias("informational"),
    )


@query(f"SELECT vec_id, arg_max('s'||s.label, {_SIM}) AS cluster, {r(f'max({_SIM})')} AS similarity FROM embeddings e, {_SEED} s GROUP BY vec_id")
def assign_centroid(spark, sf):
    found = C.assign(table(spark, sf, "embeddings"), _seeds(spark, sf), "embedding")
    return found.select("vec_id", "cluster", rounded("similarity", 6).alias("similarity"))


@query(f"SELECT intent, count(*) AS n, least(greatest(2, floor(sqrt(count(*)/2)))::BIGINT, 80, count(*)) AS k FROM {DECIDED} GROUP BY intent")
def cluster_k(spark, sf):
    n = F.col("n")
    counts = decided(spark, sf).groupBy("intent").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.least(F.greatest(F.lit(2), F.floor(F.sqrt(n / 2))), F.lit(80), n))
