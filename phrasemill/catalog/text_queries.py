"""Queries of the text functions and filters."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrases as P
from ..sources.written import written
from . import query
from .inputs import DECIDED, LABELLED, PHRASES_DOC, PHRASES_PART, SHEET, alias, decided, h32, labelled, norm, phrases_doc, phrases_part, r, sheet

MARKERS = ("with", "the of", "ander*", "mente*", "that")
RX = T.marker_regex(MARKERS)
FOLD = "replace(lower(phrase),'ё','е')"


@query(f"SELECT source_row, {norm('phrase')} AS normalized FROM {PHRASES_DOC}")
def normalize(spark, sf):
    return phrases_doc(spark, sf).select("source_row", T.normalize("phrase").alias("normalized"))


def _dash(most, default):
    return f"coalesce(nullif(left(replace({norm('phrase')},' ','-'),{most}),''),'{default}')"


@query(f"SELECT source_row, {_dash(100, 'topic')} AS topic_key FROM {PHRASES_DOC}")
def topic_key(spark, sf):
    return phrases_doc(spark, sf).select("source_row", T.topic_key("phrase").alias("topic_key"))


@query(f"SELECT source_row, {_dash(80, 'seo-job')} AS slug FROM {PHRASES_DOC}")
def slugify(spark, sf):
    return phrases_doc(spark, sf).select("source_row", T.slugify("phrase").alias("slug"))


@query(f"SELECT source_row, len(string_split_regex(trim(phrase),'\\s+'))::INT AS words FROM {PHRASES_DOC}")
def word_count(spark, sf):
    return phrases_doc(spark, sf).select("source_row", T.word_count("phrase").alias("words"))


@query(f"SELECT source_row, regexp_matches({norm('phrase')}, '{RX}') AS hit FROM {PHRASES_DOC}")
def marker_hits(spark, sf):
    return phrases_doc(spark, sf).select("source_row", T.hits(T.normalize("phrase"), MARKERS).alias("hit"))


@query(f"SELECT source_row, regexp_matches({FOLD}, '{RX}') AS hit FROM {PHRASES_DOC}")
def signal_mask(spark, sf):
    return phrases_doc(spark, sf).select("source_row", T.hits(T.folded("phrase"), MARKERS).alias("hit"))


_MARK = "trim(regexp_replace(replace(lower(marker),'ё','е'),'[^a-zа-я0-9*]+',' ','g'))"
_WORDS = f"SELECT DISTINCT left(phrase, 3 + (source_row % 4)::INT)||'*' AS marker FROM {PHRASES_DOC}"


@query(f"""SELECT marker, CASE WHEN {_MARK} = '' THEN 'empty' WHEN len(list_filter(string_split({_MARK},' '),
    lambda t: contains(t,'*') AND length(replace(t,'*','')) < 4)) > 0 THEN 'wildcard_stem_too_short' END AS reason FROM ({_WORDS})""")
def marker_safety(spark, sf):
    words = phrases_doc(spark, sf).select(F.concat(F.expr("left(phrase, int(3 + source_row % 4))"), F.lit("*")).alias("marker")).distinct()
    return words.withColumn("reason", T.unsafe_reason_column("marker"))


_PAIRS = [(a, b) for a in ("ander*", "with", "thin* mor*", "for*") for b in ("an*", "without", "more", "thing", "fo", "zz")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}',{'true' if T.overlaps(a, [b]) else 'false'})" for a, b in _PAIRS) + ") t(family, signal, overlap)")
def family_overlap(spark, sf):
    """Stem overlap either way, token by token, as a join of families and signals."""
    pairs = spark.createDataFrame(_PAIRS, "family string, signal string")
    stem = lambda x: F.rtrim(x, F.lit("*"))
    family = stem(F.col("family"))
    alike = F.exists(F.split("signal", " "), lambda t: (stem(t) != "") & (F.startswith(family, stem(t)) | F.startswith(stem(t), family)))
    return pairs.select("family", "signal", alike.alias("overlap"))


@query(f"SELECT source_row, phrase FROM {PHRASES_DOC} WHERE {h32('phrase')} % 40 = 0")
def stable_sample(spark, sf):
    return phrases_doc(spark, sf).where(T.in_sample("phrase", 40)).select("source_row", "phrase")


@query(f"SELECT sample_id, {alias('model_label')} AS label FROM {SHEET}")
def label_alias(spark, sf):
    return sheet(spark, sf).select("sample_id", T.label_of("model_label").alias("label"))


@query(f"""SELECT sample_id, e[1] AS id, e[2] AS label, e[3] AS confidence FROM (SELECT sample_id, unnest(list_filter(list_transform(
    string_split(sample_id||' | '||model_label||'|0.5; bad|x ;row|a|b',';'), lambda v: list_transform(string_split(v,'|'), lambda x: trim(x))),
    lambda v: len(v) = 3 AND len(list_filter(v, lambda x: x = '')) = 0)) AS e FROM {SHEET})""")
def parse_inline_labels(spark, sf):
    cell = F.concat("sample_id", F.lit(" | "), "model_label", F.lit("|0.5; bad|x ;row|a|b"))
    rows = sheet(spark, sf).select("sample_id", F.explode(T.inline_fields(cell, 3)).alias("e"))
    return rows.select("sample_id", F.col("e")[0].alias("id"), F.col("e")[1].alias("label"), F.col("e")[2].alias("confidence"))


@query(f"""SELECT sample_id, e[1] AS id, e[2] AS decision FROM (SELECT sample_id, unnest(list_filter(list_transform(
    string_split(sample_id||'|'||model_label||';x| mixed ;y|',';'), lambda v: list_transform(string_split(v,'|'), lambda x: trim(x))),
    lambda v: len(v) = 2 AND len(list_filter(v, lambda x: x = '')) = 0)) AS e FROM {SHEET})""")
def parse_inline_decisions(spark, sf):
    cell = F.concat("sample_id", F.lit("|"), "model_label", F.lit(";x| mixed ;y|"))
    rows = sheet(spark, sf).select("sample_id", F.explode(T.inline_fields(cell, 2)).alias("e"))
    return rows.select("sample_id", F.col("e")[0].alias("id"), F.col("e")[1].alias("decision"))


@query(f"""WITH v AS (SELECT source_row, list_filter(list_transform(string_split(replace(phrase,' ',';')||'; two  words',';'),
        lambda x: trim(regexp_replace(x,'\\s+',' ','g'))), lambda x: x <> '') AS l FROM {PHRASES_DOC}),
    w AS (SELECT source_row, l, list_transform(l, lambda x: lower(x)) AS low FROM v)
    SELECT source_row, array_to_string((list_filter(l, lambda x, k: list_position(low, lower(x)) = k))[1:15], '|') AS signals FROM w""")
def parse_policy_list(spark, sf):
    cell = F.concat(F.replace("phrase", F.lit(" "), F.lit(";")), F.lit("; two  words"))
    return phrases_doc(spark, sf).select("source_row", F.array_join(T.policy_list(cell, 15), "|").alias("signals"))


@query(f"SELECT source_row, phrase FROM {PHRASES_PART} WHERE trim(phrase) <> ''")
def non_blank(spark, sf):
    return P.non_blank(phrases_part(spark, sf)).select("source_row", "phrase")


@query(f"SELECT source_row, intent FROM {DECIDED} WHERE intent IN ('commercial','informational')")
def filter_intent(spark, sf):
    return decided(spark, sf, "source_row", "intent").where(F.col("intent").isin("commercial", "informational"))


@query(f"SELECT source_row, {r('p_garbage')} AS p_garbage FROM {DECIDED} WHERE quarantined")
def quarantine(spark, sf):
    return decided(spark, sf).where("quarantined").select("source_row", T.rounded("p_garbage", 6).alias("p_garbage"))


@query(f"""SELECT n.normalized, n.phrase, n.occurrences, n.search_volume, n.source_row, length(n.normalized)::INT AS length,
    {r('ln(1+greatest(n.search_volume,0.0))+ln(1+n.occurrences)')} AS priority FROM (
    SELECT normalized, arg_min(phrase, source_row) AS phrase, count(*) AS occurrences, max(coalesce(search_volume,0.0)) AS search_volume,
    min(source_row) AS source_row FROM (SELECT *, {norm('phrase')} AS normalized FROM {PHRASES_PART} WHERE trim(phrase) <> '') GROUP BY normalized) n""")
def phrase_table(spark, sf):
    return P.phrase_table(phrases_part(spark, sf)).withColumn("priority", T.rounded("priority", 6))


@query(f"""SELECT part, normalized, source_row FROM (SELECT *, source_row // 500 AS part, {norm('phrase')} AS normalized FROM {PHRASES_PART})
    QUALIFY row_number() OVER (PARTITION BY part, normalized ORDER BY source_row) = 1""")
def chunk_dedup(spark, sf):
    rows = phrases_part(spark, sf).withColumn("part", F.expr("source_row div 500")).withColumn("normalized", T.normalize("phrase"))
    return P.chunk_dedup(rows).select("part", "normalized", "source_row")


_TABLE = f"""(SELECT normalized, count(*) AS occurrences, max(search_volume) AS search_volume, min(source_row) AS source_row,
    ln(1+max(search_volume))+ln(1+count(*)) AS priority, length(normalized) AS length
    FROM (SELECT *, {norm('phrase')} AS normalized FROM {PHRASES_PART}) GROUP BY normalized)"""


@query(f"""SELECT 'priority' AS slice, normalized FROM (SELECT * FROM {_TABLE} ORDER BY priority DESC, source_row LIMIT 20)
    UNION ALL SELECT 'length', normalized FROM (SELECT * FROM {_TABLE} ORDER BY length DESC, source_row LIMIT 10)""")
def sample_top_slices(spark, sf):
    t = P.phrase_table(phrases_part(spark, sf))
    important = P.top(t, 20, F.desc("priority"), "source_row").select(F.lit("priority").alias("slice"), "normalized")
    return important.unionByName(P.top(t, 10, F.desc("length"), "source_row").select(F.lit("length").alias("slice"), "normalized"))


@query(f"SELECT DISTINCT normalized FROM (SELECT {norm('phrase')} AS normalized FROM {PHRASES_DOC}) ORDER BY md5(normalized), normalized LIMIT 5000")
def hash_reservoir(spark, sf):
    return P.hash_sample(phrases_doc(spark, sf).select(T.normalize("phrase").alias("normalized")).distinct(), 5000, "normalized")


@query(f"SELECT source_row, phrase, search_volume FROM {PHRASES_PART} ORDER BY search_volume DESC, source_row LIMIT 160")
def top_volume(spark, sf):
    return P.top(phrases_part(spark, sf), 160, F.desc("search_volume"), "source_row").select("source_row", "phrase", "search_volume")


@query()
def representative_sample(spark, sf):
    phrases = written(P.phrase_table(phrases_doc(spark, sf).withColumn("search_volume", F.lit(1.0))), "phrases")
    return P.representative_sample(phrases, 800).select("normalized", "reason", "source_row")


@query(f"SELECT label, count(*) AS n FROM {LABELLED} GROUP BY label")
def label_counts(spark, sf):
    return labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
