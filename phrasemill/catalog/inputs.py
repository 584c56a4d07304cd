"""Inputs of the queries, derived from the given tables, in Spark and as SQL fragments for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash32, normalize, unit_interval
from ..operators.decide import Settings, decide
from ..sources.written import evaluated, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL fragments ---------------------------------------------------------------------------------------------------------


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}),'ё','е'),'[^a-zа-я0-9]+',' ','g'))"


def h32(x: str) -> str:
    return f"('0x'||left(md5({x}),8))::UBIGINT::BIGINT"


def unit(x: str, salt: str) -> str:
    return f"({h32(f"{x}||'{salt}'")}::DOUBLE/4294967295.0)"


def r(x: str, digits: int = 6) -> str:
    return f"(round_even(({x})*1e{digits},0)/1e{digits})"


# -- phrases ---------------------------------------------------------------------------------------------------------------


def phrases_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts: many duplicates, a volume and the row."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("phrase"), F.col("p_retailprice").alias("search_volume"), F.col("p_partkey").alias("source_row"))


PHRASES_PART = "(SELECT p_name AS phrase, p_retailprice AS search_volume, p_partkey AS source_row FROM part)"


def phrases_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the documents: doc_id, pos, phrase, source_row."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "phrase"))
    docs = docs.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.trim("phrase").alias("phrase")).where("phrase <> ''")
    return docs.withColumn("source_row", F.col("doc_id") * 100000 + F.col("pos"))


PHRASES_DOC = r"""(SELECT doc_id, pos, phrase, doc_id * 100000 + pos AS source_row FROM (
    SELECT doc_id, unnest(range(len(s))) AS pos, trim(unnest(s)) AS phrase
    FROM (SELECT doc_id, string_split_regex(text, '[.\n]') AS s FROM documents)) WHERE phrase <> '')"""


# -- labelled phrases ------------------------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of labelled documents: doc_id, pos, phrase, source_row, label."""
    label = F.when(F.col("toxic") == 1, "garbage").when(F.col("quality") == 1, "commercial").otherwise("informational")
    return phrases_doc(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", label.alias("label")), "doc_id")


LABELLED = f"""(SELECT p.*, CASE WHEN toxic = 1 THEN 'garbage' WHEN quality = 1 THEN 'commercial' ELSE 'informational' END AS label
    FROM {PHRASES_DOC} p JOIN labels l ON p.doc_id = l.doc_id)"""

#: Fixed values of the generated label sheet.
RAW = {"commercial": ("commercial", " Transactional ", "коммерческие"), "informational": ("informational", "Information", "информационный"), "garbage": ("garbage", "irrelevant", "МУСОР")}
SOURCES = ("current representative sample", "current family coverage sample", "model_reviewed", "review_corrected")


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label sheet with blanks, aliases, invalid labels and gaps in the confidence."""
    rows = labelled(spark, sf_dir)
    key = F.concat(F.col("source_row").cast("string"), F.lit("s"))
    h = hash32(key)
    raw = F.element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in RAW.items() for x in pair]), F.col("label"))
    return rows.select(
        "doc_id",
        "source_row",
        F.format_string("row-%06d", F.col("source_row")).alias("sample_id"),
        "phrase",
        F.when(h % 7 == 0, "").when(h % 31 == 1, "unsure").otherwise(F.element_at(raw, (h % 3 + 1).cast("int"))).alias("model_label"),
        F.when(h % 11 == 0, None).when(h % 37 == 1, 1.5).otherwise(unit_interval(key, "c")).alias("model_confidence"),
        F.when(h % 5 == 0, "checked").otherwise("").alias("model_notes"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (h % 4 + 1).cast("int")).alias("knowledge_source"),
        F.when(h % 6 == 0, F.concat(F.substring(normalize("phrase"), 1, 5), F.lit("*"))).otherwise("").alias("coverage_family"),
        F.floor(unit_interval(key, "v") * 1000).cast("double").alias("search_volume"),
        (h % 9 + 1).alias("occurrences"),
    )


_SK = "(source_row::VARCHAR||'s')"
_RAW_SQL = " ".join(f"WHEN label = '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in RAW.items())
SHEET = f"""(SELECT doc_id, source_row, printf('row-%06d', source_row) AS sample_id, phrase,
    CASE WHEN h % 7 = 0 THEN '' WHEN h % 31 = 1 THEN 'unsure' ELSE (CASE {_RAW_SQL} END)[h % 3 + 1] END AS model_label,
    CASE WHEN h % 11 = 0 THEN NULL WHEN h % 37 = 1 THEN 1.5::DOUBLE ELSE {unit(_SK, 'c')} END AS model_confidence,
    CASE WHEN h % 5 = 0 THEN 'checked' ELSE '' END AS model_notes,
    [{', '.join(repr(x) for x in SOURCES)}][h % 4 + 1] AS knowledge_source,
    CASE WHEN h % 6 = 0 THEN left({norm('phrase')}, 5)||'*' ELSE '' END AS coverage_family,
    floor({unit(_SK, 'v')}*1000)::DOUBLE AS search_volume, h % 9 + 1 AS occurrences
    FROM (SELECT *, {h32(_SK)} AS h FROM {LABELLED}))"""

_ALIAS_SQL = """CASE lower(trim({x})) WHEN 'коммерческий' THEN 'commercial' WHEN 'коммерческие' THEN 'commercial' WHEN 'commercial' THEN 'commercial'
    WHEN 'transactional' THEN 'commercial' WHEN 'информационный' THEN 'informational' WHEN 'информационные' THEN 'informational'
    WHEN 'informational' THEN 'informational' WHEN 'information' THEN 'informational' WHEN 'мусор' THEN 'garbage'
    WHEN 'garbage' THEN 'garbage' WHEN 'irrelevant' THEN 'garbage' END"""


def alias(x: str) -> str:
    return _ALIAS_SQL.format(x=x)


# -- scored and decided phrases --------------------------------------------------------------------------------------------

#: Markers and rules that occur in the given texts.
SETTINGS = Settings(
    commercial_markers=("with", "ne*", "para"),
    informational_markers=("that", "mente*"),
    weak_question_markers=("for", "qui", "wie"),
    commercial_families=("inere*", "and the", "onthe*", "un"),
    informational_families=("tioni*", "of the", "ander*", "forma*"),
    neutral_families=("being*",),
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with stable pseudo-random scores: the decision logic's input."""
    p = phrases_doc(spark, sf_dir).withColumn("normalized", normalize("phrase"))
    return p.select(
        "doc_id",
        "source_row",
        "phrase",
        "normalized",
        F.floor(unit_interval("phrase", "v") * 1000).cast("double").alias("search_volume"),
        (hash32(F.concat("phrase", F.lit("o"))) % 9 + 1).alias("occurrences"),
        (unit_interval("normalized", "g") * 0.7).alias("pg"),
        unit_interval("normalized", "c").alias("c"),
        (1.0 - unit_interval("normalized", "c")).alias("i"),
        unit_interval("normalized", "x").alias("cs"),
        unit_interval("normalized", "y").alias("is_"),
        F.when(hash32(F.concat("normalized", F.lit("k"))) % 40 == 0, "Unclustered").otherwise(F.concat(F.lit("c"), (hash32(F.concat("normalized", F.lit("k"))) % 12).cast("string"))).alias("cluster"),
        unit_interval("normalized", "p").alias("cluster_probability"),
        unit_interval("normalized", "t").alias("topic_relevance"),
        (F.col("doc_id") % 8).alias("part"),
    )


_K = h32("normalized||'k'")
SCORED = f"""(SELECT doc_id, source_row, phrase, normalized, floor({unit('phrase', 'v')}*1000)::DOUBLE AS search_volume,
    {h32("phrase||'o'")} % 9 + 1 AS occurrences, {unit('normalized', 'g')}*0.7 AS pg, {unit('normalized', 'c')} AS c,
    1.0 - {unit('normalized', 'c')} AS i, {unit('normalized', 'x')} AS cs, {unit('normalized', 'y')} AS is_,
    CASE WHEN {_K} % 40 = 0 THEN 'Unclustered' ELSE 'c'||({_K} % 12)::VARCHAR END AS cluster,
    {unit('normalized', 'p')} AS cluster_probability, {unit('normalized', 't')} AS topic_relevance, doc_id % 8 AS part
    FROM (SELECT *, {norm('phrase')} AS normalized FROM {PHRASES_DOC}))"""


def decided(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The decided sentences, of which a query that reads few columns names them; filters on them do not repeat the decision."""
    found = decide(scored(spark, sf_dir), SETTINGS)
    return evaluated(found.select(*columns) if columns else found)


def _rx(markers) -> str:
    from ..functions.text import marker_regex

    return marker_regex(markers) or "$^"


def decided_sql(s: Settings = SETTINGS) -> str:
    rules = s.family_rules()
    family = lambda label: _rx([p for p, x in rules.items() if x == label])
    hit = lambda pattern: f"regexp_matches(normalized, '{pattern}')"
    from ..functions.text import safe_markers

    return f"""(
    WITH a AS (SELECT *, CASE WHEN greatest(cs, is_) >= {s.minimum_similarity} THEN greatest(least(cs - is_, 0.2), -0.2) * {s.policy_strength} ELSE 0.0 END AS adj,
        {hit(_rx(safe_markers(s.informational_markers)))} AS im, {hit(_rx(safe_markers(s.commercial_markers)))} AS cm,
        {hit(_rx(s.weak_question_markers))} AS wm, {hit(family('informational'))} AS fi, {hit(family('commercial'))} AS fc FROM {SCORED}),
    b AS (SELECT *, greatest(c + adj, 1e-8::DOUBLE) AS c1, greatest(i - adj, 1e-8::DOUBLE) AS i1, wm AND NOT cm AND NOT fc AS wq FROM a),
    d AS (SELECT *, c1/(c1+i1) AS cc, i1/(c1+i1) AS ii, CASE WHEN im OR is_ >= cs + {s.evidence_margin} THEN {s.strong_margin} ELSE {s.margin} END AS m0 FROM b),
    e AS (SELECT *, CASE WHEN wq THEN least(m0, {s.weak_margin}) ELSE m0 END AS m FROM d),
    f AS (SELECT *, CASE WHEN im AND NOT cm THEN 'informational' WHEN cm AND NOT im THEN 'commercial'
        WHEN ii >= cc + m THEN 'informational' ELSE 'commercial' END AS pre,
        ii + {s.family_tolerance} >= cc AS si, cc + {s.family_tolerance} >= ii AS sc FROM e),
    g AS (SELECT *, fi AND NOT fc AND NOT cm AND si AS ai, fc AND NOT fi AND NOT im AND sc AS ac,
        (fi AND fc) OR (fi AND cm) OR (fc AND im) OR (fi AND NOT si) OR (fc AND NOT sc) AS conflict FROM f),
    h AS (SELECT *, CASE WHEN ai THEN 'informational' WHEN ac THEN 'commercial' ELSE pre END AS rel FROM g)
    SELECT doc_id, source_row, phrase, normalized, search_volume, occurrences, cluster, cluster_probability, topic_relevance, part,
        CASE WHEN pg >= {s.garbage_threshold} THEN 'garbage' ELSE rel END AS intent, pre AS pre_family_intent,
        (1.0-pg)*cc AS p_commercial, (1.0-pg)*ii AS p_informational, pg AS p_garbage,
        CASE WHEN pg >= {s.garbage_threshold} THEN pg WHEN rel = 'commercial' THEN (1.0-pg)*cc ELSE (1.0-pg)*ii END AS confidence,
        adj AS policy_adjustment, im AS informational_marker, cm AS commercial_marker, wm AS weak_question, wq AS weak_without_transaction,
        fi AS informational_family, fc AS commercial_family, conflict AS family_conflict,
        rel <> pre AND (ai OR ac) AND pg < {s.garbage_threshold} AS family_override,
        pg >= {s.quarantine_threshold} AND pg < {s.garbage_threshold} AS quarantined FROM h)"""


DECIDED = decided_sql()
