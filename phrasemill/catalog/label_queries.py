"""Queries of label sheets, signals and the knowledge store."""

from pyspark.sql import functions as F

from ..functions.text import marker_regex, normalize, rounded
from ..operators import labels as L
from ..operators.decide import basis, override_with_labels
from . import query
from .inputs import DECIDED, LABELLED, SHEET, alias, decided, h32, labelled, norm, r, sheet

_LAB = f"(SELECT *, trim(phrase) AS p, {alias('model_label')} AS label, CASE WHEN model_confidence BETWEEN 0 AND 1 THEN model_confidence END AS confidence FROM {SHEET})"
_LAST = f"""(SELECT normalized, p AS phrase, label, model_notes, knowledge_source, source_row FROM (SELECT *, {norm('p')} AS normalized FROM {_LAB} WHERE label IS NOT NULL AND p <> '')
    QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY source_row DESC) = 1)"""


@query(f"SELECT * FROM {_LAST}")
def load_labels_last_wins(spark, sf):
    return L.last_wins(sheet(spark, sf))


@query(f"SELECT sample_id, label IS NOT NULL AND confidence IS NOT NULL AS reviewed FROM {_LAB}")
def reviewed_mask(spark, sf):
    return L.with_label(sheet(spark, sf)).select("sample_id", L.reviewed().alias("reviewed"))


@query(f"SELECT label, count(*) AS n FROM {_LAB} WHERE p <> '' AND label IS NOT NULL AND knowledge_source NOT IN ('model_reviewed','review_corrected') GROUP BY label")
def current_sample_counts(spark, sf):
    return L.current_counts(sheet(spark, sf))


_KEY = "regexp_replace(replace(lower(p),'ё','е'),'\\s+',' ','g')"
_CONF = f"(SELECT {_KEY} AS phrase_key, count(DISTINCT label) AS labels FROM {_LAB} WHERE label IS NOT NULL AND p <> '' GROUP BY 1 HAVING count(DISTINCT label) > 1)"


@query(f"SELECT * FROM {_CONF}")
def label_conflicts(spark, sf):
    return L.conflicts(sheet(spark, sf))


_POS = ("thing", "mente")


@query(f"""WITH l AS MATERIALIZED (SELECT *, label IS NOT NULL AND p <> '' AS ok FROM {_LAB}),
    a AS (SELECT count_if(p <> '')::BIGINT AS sample_rows, count_if(ok)::BIGINT AS valid_labeled_rows, count_if(label = 'commercial')::BIGINT AS commercial_rows,
        count_if(label = 'informational')::BIGINT AS informational_rows, count_if(label = 'garbage')::BIGINT AS garbage_rows, count_if(trim(model_label) <> '' AND label IS NULL)::BIGINT AS invalid_labels,
        count_if(ok AND confidence IS NOT NULL)::BIGINT AS confidence_complete_rows, count_if(ok AND confidence IS NULL)::BIGINT AS missing_or_invalid_confidence,
        count_if(ok AND confidence < 0.7) AS low, count_if(ok AND confidence < 0.7 AND model_notes = '')::BIGINT AS low_confidence_without_notes,
        least(10, count_if(label = 'garbage' AND (contains(replace(lower(p),'ё','е'),'{_POS[0]}') OR contains(replace(lower(p),'ё','е'),'{_POS[1]}'))))::BIGINT AS positive_marker_garbage_conflicts FROM l),
    t AS (SELECT count_if(NOT (ok AND confidence IS NOT NULL))::BIGINT AS high_priority_unreviewed FROM (SELECT * FROM l ORDER BY search_volume + occurrences DESC, source_row LIMIT 50)),
    c AS (SELECT count(*) AS conflicting_duplicate_labels FROM {_CONF})
    SELECT a.* EXCLUDE (low), t.*, c.*, least(150, sample_rows) AS required_labeled_rows, {r('garbage_rows / greatest(valid_labeled_rows, 1)')} AS garbage_share,
        {r('low / greatest(confidence_complete_rows, 1)')} AS low_confidence_share, least(30, greatest(3, (valid_labeled_rows + 9) // 10)) AS intent_coverage_target FROM a, t, c""")
def label_quality(spark, sf):
    return L.quality(sheet(spark, sf), _POS)


COM, INF, WEAK = ("with", "ander*", "para"), ("that", "mente*", "tioni*"), ("for", "qui")
_hit = lambda s: f"regexp_matches(replace(lower(phrase),'ё','е'), '{marker_regex(s)}')"


def _coverage(com, inf, weak):
    avg = lambda x, among: f"coalesce(avg(CASE WHEN {among} THEN ({x})::INT END), 0.0)"
    return f"""(SELECT commercial_examples, informational_examples, weak_informational_examples, weak_commercial_examples, {r('cc', 4)} AS commercial_coverage, {r('ic', 4)} AS informational_coverage,
        {r('ifp', 4)} AS informational_false_positive, {r('cfp', 4)} AS commercial_false_positive, {r('wi', 4)} AS weak_informational_coverage, {r('wc', 4)} AS weak_commercial_coverage,
        e AS eligible, e AND (ic < 0.55 OR ifp > 0.15 OR cfp > 0.15 OR (weak_informational_examples >= 5 AND wi < 0.5) OR (weak_commercial_examples >= 5 AND wc < 0.5)) AS needs_refinement,
        {r('0.5*(cc+ic) - 0.75*(ifp+cfp)', 4)} AS quality_score FROM (SELECT *, commercial_examples >= 30 AND informational_examples >= 30 AS e FROM (
        SELECT count_if(com)::BIGINT AS commercial_examples, count_if(inf)::BIGINT AS informational_examples, {avg('c', 'com')} AS cc, {avg('i', 'inf')} AS ic,
        {avg('i AND NOT c', 'com')} AS ifp, {avg('c AND NOT i', 'inf')} AS cfp, count_if(w AND inf)::BIGINT AS weak_informational_examples, count_if(w AND com)::BIGINT AS weak_commercial_examples,
        {avg('i', 'w AND inf')} AS wi, {avg('c', 'w AND com')} AS wc
        FROM (SELECT label = 'commercial' AS com, label = 'informational' AS inf, {_hit(com)} AS c, {_hit(inf)} AS i, {_hit(weak)} AS w FROM {LABELLED}))))"""


@query(f"SELECT * FROM {_coverage(COM, INF, WEAK)}")
def signal_coverage(spark, sf):
    return L.signal_coverage(labelled(spark, sf), COM, INF, WEAK)


_NEW = ("the", "with")


@query(f"""SELECT c.eligible AND NOT s AND NOT f1 AND NOT f2 AS safe, s AS score_regressed, f1 AS informational_regressed, f2 AS commercial_regressed FROM (
    SELECT c.eligible, c.quality_score + 0.02 < b.quality_score AS s, c.informational_false_positive > greatest(0.2, b.informational_false_positive + 0.03) AS f1,
    c.commercial_false_positive > greatest(0.2, b.commercial_false_positive + 0.03) AS f2 FROM {_coverage(COM, INF, WEAK)} b, {_coverage(_NEW, INF, WEAK)} c) c""")
def policy_guard(spark, sf):
    """The guard on two rows of coverage; here the baseline's signals against a broader list."""
    rows = labelled(spark, sf)
    old, new = (L.signal_coverage(rows, s, INF, WEAK).first().asDict() for s in (COM, _NEW))
    safe, reasons = L.policy_guard(old, new)
    return spark.createDataFrame([(safe, *(x in reasons for x in ("signal_quality_score_regressed", "informational_false_positive_regressed", "commercial_false_positive_regressed")))], "safe boolean, score_regressed boolean, informational_regressed boolean, commercial_regressed boolean")


_SIG = ("with", "ne*", "ander*", "the", "onthe*")
_san = " UNION ALL ".join(f"SELECT '{s}' AS signal, {'true' if s == 'ne*' else 'false'} AS short, count_if({_hit([s])} AND label = 'commercial')::BIGINT AS e, count_if({_hit([s])} AND label = 'informational')::BIGINT AS o FROM {LABELLED}" for s in _SIG)


@query(f"SELECT signal, CASE WHEN short THEN 'wildcard_stem_too_short' WHEN e + o >= 4 AND o >= 2 AND o/(e+o) >= 0.3 THEN 'reviewed_label_collision' END AS reason, e AS expected_examples, o AS opposite_examples FROM ({_san})")
def sanitize_signals(spark, sf):
    return L.sanitize(labelled(spark, sf), _SIG, "commercial")


@query(f"""WITH a AS (SELECT *, trim(regexp_replace(replace(lower(phrase),'ё','е'),'\\s+',' ','g')) AS k FROM {LABELLED} WHERE phrase <> ''),
    l AS (SELECT 'topic.relevant_seeds' AS seed_list, * FROM a WHERE label <> 'garbage' UNION ALL SELECT 'intent.commercial_seeds', * FROM a WHERE label = 'commercial'
        UNION ALL SELECT 'intent.informational_seeds', * FROM a WHERE label = 'informational' UNION ALL SELECT 'topic.garbage_seeds', * FROM a WHERE label = 'garbage'),
    f AS (SELECT seed_list, k, min(source_row) AS s, arg_min(phrase, source_row) AS phrase FROM l GROUP BY 1, 2)
    SELECT seed_list, row_number() OVER (PARTITION BY seed_list ORDER BY s)::INT AS place, phrase FROM f QUALIFY place <= 5""")
def bootstrap_seeds(spark, sf):
    return L.bootstrap_seeds(labelled(spark, sf))


_OV = (("with", "Price", "for*"), ("that", "price", "how"))


@query("SELECT * FROM (VALUES ('price')) t(signal)")
def signal_overlap(spark, sf):
    return spark.createDataFrame([(s,) for s in L.signal_overlap(*_OV)], "signal string")


_PAT = f"(SELECT DISTINCT left({norm('phrase')}, 5)||'*' AS pattern FROM {LABELLED} WHERE length({norm('phrase')}) >= 5)"
_CAND = f"(SELECT 'IF'||{h32('pattern')} AS id, pattern, 'lexical' AS kind, {h32('pattern')} % 2 = 0 AS safe, ['commercial','informational','neutral'][{h32('pattern')} % 3 + 1] AS label FROM {_PAT})"


@query(f"""SELECT id, pattern, CASE WHEN forced THEN 'neutral' ELSE label END AS label, forced FROM (SELECT *, label <> 'neutral' AND (NOT safe
    OR starts_with(rtrim(pattern,'*'),'thin') OR starts_with('thin',rtrim(pattern,'*')) OR starts_with(rtrim(pattern,'*'),'for') OR starts_with('for',rtrim(pattern,'*'))) AS forced FROM {_CAND})""")
def family_rules(spark, sf):
    from ..functions.text import hash32

    n = normalize("phrase")
    patterns = labelled(spark, sf).where(F.char_length(n) >= 5).select(F.concat(F.substring(n, 1, 5), F.lit("*")).alias("pattern")).distinct()
    h = hash32("pattern")
    rows = patterns.select(F.concat(F.lit("IF"), h.cast("string")).alias("id"), "pattern", F.lit("lexical").alias("kind"), (h % 2 == 0).alias("safe_decisive_lexical"))
    chosen = patterns.select(F.concat(F.lit("IF"), h.cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, ("commercial", "informational", "neutral"))), (h % 3 + 1).cast("int")).alias("label"))
    return L.family_rules(rows, chosen, ("thin*", "for"))


@query(f"""WITH u AS (SELECT sample_id, 'garbage' AS l, 0.5::DOUBLE AS c, 'again' AS n FROM {SHEET} WHERE {h32("sample_id||'u'")} % 5 = 0)
    SELECT s.sample_id, coalesce(l, model_label) AS model_label, {r('coalesce(c, model_confidence)')} AS model_confidence, coalesce(n, model_notes) AS model_notes FROM {SHEET} s LEFT JOIN u ON s.sample_id = u.sample_id""")
def apply_labels(spark, sf):
    from ..functions.text import in_sample

    s = sheet(spark, sf)
    updates = s.where(in_sample(F.concat("sample_id", F.lit("u")), 5)).select("sample_id", F.lit("garbage").alias("label"), F.lit(0.5).alias("confidence"), F.lit("again").alias("notes"))
    return L.apply_labels(s, updates).select("sample_id", "model_label", rounded("model_confidence", 6).alias("model_confidence"), "model_notes")


@query(f"SELECT sample_id, phrase FROM {_LAB} WHERE label IS NULL AND p <> '' ORDER BY search_volume DESC, sample_id LIMIT 25 OFFSET 25")
def sample_page(spark, sf):
    return L.sample_page(sheet(spark, sf), 25, 25).select("sample_id", "phrase")


@query(f"SELECT sample_id FROM (SELECT * FROM {_LAB} ORDER BY search_volume + occurrences DESC, source_row LIMIT 50) WHERE label IS NULL OR confidence IS NULL")
def priority_review(spark, sf):
    return L.priority_review(sheet(spark, sf)).select("sample_id")


@query(f"SELECT sample_id, coverage_family FROM {_LAB} WHERE coverage_family <> '' AND (label IS NULL OR confidence IS NULL) ORDER BY coverage_family, sample_id LIMIT 50")
def family_coverage_review(spark, sf):
    return L.family_review(sheet(spark, sf), 50).select("sample_id", "coverage_family")


@query(f"SELECT count(*) AS total, count_if(label IS NOT NULL AND confidence IS NOT NULL)::BIGINT AS reviewed, count_if(label IS NULL OR confidence IS NULL)::BIGINT AS remaining FROM {_LAB} WHERE coverage_family <> ''")
def family_coverage_status(spark, sf):
    return L.family_status(sheet(spark, sf))


_PRIOR = f"(SELECT normalized, source_row FROM {_LAST} WHERE knowledge_source IN ('model_reviewed','review_corrected'))"


@query(f"""SELECT normalized, turn, source_row FROM (SELECT * FROM (SELECT normalized, source_row, 0 AS turn FROM {_PRIOR} UNION ALL SELECT {norm('phrase')}, source_row, 1 FROM {SHEET})
    QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY turn, source_row) = 1) ORDER BY turn, source_row LIMIT 800""")
def merge_prior_sample(spark, sf):
    s = sheet(spark, sf)
    prior = L.last_wins(s).where(F.col("knowledge_source").isin(*L.AUXILIARY)).select("normalized", "source_row")
    return L.merge_prior(prior, s.select(normalize("phrase").alias("normalized"), "source_row"), 800).select("normalized", "turn", "source_row")


@query(f"""SELECT "group", label, row_number() OVER (PARTITION BY "group", label ORDER BY search_volume DESC, source_row)::INT AS place, phrase FROM (
    SELECT 'examples' AS "group", label, p AS phrase, search_volume, source_row FROM {_LAB} WHERE label IS NOT NULL AND p <> ''
    UNION ALL SELECT 'weak_question', label, p, search_volume, source_row FROM {_LAB} WHERE label IN ('commercial','informational') AND p <> '' AND {_hit(WEAK)}) QUALIFY place <= 8""")
def policy_context(spark, sf):
    return L.policy_context(L.with_label(sheet(spark, sf)), WEAK, 8)


# -- knowledge -------------------------------------------------------------------------------------------------------------------


def _knowledge(spark, sf):
    rows = L.with_label(sheet(spark, sf)).where("label is not null and phrase <> ''")
    keyed = rows.select(
        F.concat(F.lit("topic-"), (F.col("doc_id") % 3).cast("string")).alias("topic_key"), normalize("phrase").alias("phrase_key"), "phrase", "label",
        F.coalesce("model_confidence", F.lit(0.8)).alias("confidence"), F.when(F.col("knowledge_source") == "review_corrected", "review_corrected").otherwise("model_reviewed").alias("verification"),
        F.concat(F.lit("job-"), (F.col("doc_id") % 5).cast("string")).alias("source_job"), F.col("source_row").alias("seq"))
    return keyed


_KN = f"""(SELECT 'topic-'||(doc_id % 3) AS topic_key, {norm('p')} AS phrase_key, p AS phrase, label, greatest(0.0, least(1.0, coalesce(model_confidence, 0.8))) AS confidence,
    CASE WHEN knowledge_source = 'review_corrected' THEN knowledge_source ELSE 'model_reviewed' END AS verification, 'job-'||(doc_id % 5) AS source_job, source_row AS seq FROM {_LAB} WHERE label IS NOT NULL AND p <> '')"""
_UP = f"""(SELECT topic_key, phrase_key, arg_max(phrase, seq) AS phrase, arg_max(label, seq) AS label, max(confidence) AS confidence,
    CASE WHEN bool_or(verification = 'review_corrected') THEN 'review_corrected' ELSE arg_min(verification, seq) END AS verification, arg_max(source_job, seq) AS source_job, max(seq) AS seq FROM {_KN} GROUP BY 1, 2)"""


def _stored(spark, sf):
    rows = _knowledge(spark, sf)
    half = (F.col("seq") / 100000).cast("bigint") % 2
    return L.upsert(rows.where(half == 0), rows.where(half == 1))


@query(f"SELECT topic_key, phrase_key, phrase, label, {r('confidence')} AS confidence, verification, source_job, seq FROM {_UP}")
def knowledge_upsert(spark, sf):
    return _stored(spark, sf).withColumn("confidence", rounded("confidence", 6))


@query(f"SELECT phrase_key, label, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, seq DESC, phrase_key)::INT AS place FROM {_UP} WHERE topic_key = 'topic-1' QUALIFY place <= 50")
def balanced_examples(spark, sf):
    return L.balanced(_stored(spark, sf), "topic-1", 150).select("phrase_key", "label", "place")


@query(f"SELECT topic_key, label, verification, count(*) AS n FROM {_UP} GROUP BY 1, 2, 3")
def knowledge_status(spark, sf):
    return L.knowledge_status(_stored(spark, sf))


@query(f"SELECT t.topic_key, coalesce(n, 0) AS n FROM (VALUES ('topic-0'),('topic-1'),('topic-2'),('topic-9')) t(topic_key) LEFT JOIN (SELECT topic_key, count(*) AS n FROM {_UP} GROUP BY 1) e ON t.topic_key = e.topic_key")
def knowledge_topics(spark, sf):
    topics = spark.createDataFrame([(f"topic-{k}",) for k in (0, 1, 2, 9)], "topic_key string")
    return L.knowledge_topics(topics, _stored(spark, sf))


@query(f"SELECT 'topic-'||(doc_id % 3) AS topic_key, arg_max(phrase, source_row) AS profile, max(source_row) AS seq FROM {LABELLED} GROUP BY 1")
def knowledge_topic_profiles(spark, sf):
    rows = labelled(spark, sf).select(F.concat(F.lit("topic-"), (F.col("doc_id") % 3).cast("string")).alias("topic_key"), F.col("phrase").alias("profile"), F.col("source_row").alias("seq"))
    return L.upsert_topics(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


@query(f"SELECT topic_key, count(*) AS n FROM {_UP} WHERE topic_key <> 'topic-1' GROUP BY 1")
def knowledge_forget(spark, sf):
    return L.forget(_stored(spark, sf), "topic-1").groupBy("topic_key").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT phrase, {alias("['commercial','Garbage','?'][" + h32('phrase') + " % 3 + 1]")} AS label, source_row FROM {DECIDED} WHERE quarantined),
    u AS (SELECT trim(phrase) AS phrase, model_label, 0 AS turn, source_row FROM {SHEET} UNION ALL SELECT trim(phrase), label, 1, source_row FROM c WHERE label IS NOT NULL AND trim(phrase) <> '')
    SELECT lower(phrase) AS phrase_key, phrase, model_label, turn FROM u QUALIFY row_number() OVER (PARTITION BY lower(phrase) ORDER BY turn DESC, source_row DESC) = 1""")
def import_feedback(spark, sf):
    from ..functions.text import hash32

    c = decided(spark, sf).where("quarantined").select("phrase", "source_row", F.element_at(F.array(*map(F.lit, ("commercial", "Garbage", "?"))), (hash32("phrase") % 3 + 1).cast("int")).alias("correct_intent"))
    return L.import_feedback(sheet(spark, sf), c)


# -- reviewed labels over decisions -------------------------------------------------------------------------------------------------


_OVER = f"""(SELECT d.source_row, coalesce(l.label, intent) AS intent, l.label IS NOT NULL AS exact_label, CASE WHEN l.label IS NOT NULL THEN 1.0 ELSE confidence END AS confidence,
    l.label IS NULL AND quarantined AS quarantined, family_override, policy_adjustment,
    CASE WHEN l.label IS NOT NULL THEN (l.label = 'garbage')::INT::DOUBLE ELSE p_garbage END AS p_garbage FROM {DECIDED} d LEFT JOIN {_LAST} l ON d.normalized = l.normalized)"""


@query(f"SELECT source_row, intent, exact_label, {r('confidence')} AS confidence, {r('p_garbage')} AS p_garbage, quarantined FROM {_OVER}")
def exact_label_override(spark, sf):
    found = override_with_labels(decided(spark, sf), L.last_wins(sheet(spark, sf)))
    return found.select("source_row", "intent", "exact_label", rounded("confidence", 6).alias("confidence"), rounded("p_garbage", 6).alias("p_garbage"), "quarantined")


@query(f"""SELECT source_row, intent, {r('confidence')} AS confidence, CASE WHEN exact_label THEN 'Reviewed label' WHEN family_override THEN 'Reviewed family'
    WHEN abs(policy_adjustment) >= 0.01 THEN 'Classifier and topic policy' ELSE 'Classifier' END AS decision_basis FROM {_OVER}""")
def supervised_classification(spark, sf):
    found = basis(override_with_labels(decided(spark, sf), L.last_wins(sheet(spark, sf))))
    return found.select("source_row", "intent", rounded("confidence", 6).alias("confidence"), "decision_basis")
