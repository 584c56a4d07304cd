"""Queries of family mining."""

from pyspark.sql import functions as F

from ..functions import families as FF
from ..functions.text import normalize
from ..operators import families as M
from ..sources.written import written
from . import query
from .inputs import PHRASES_DOC, norm, phrases_doc

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
STOP, ANCHOR = _list(FF.STOP_WORDS), _list(FF.ANCHORS)
_anchor = lambda t: f"(starts_with({t},'как') OR list_contains({ANCHOR},{t}))"
_key = lambda t: (
    f"CASE WHEN length({t}) < 4 OR list_contains({STOP},{t}) OR NOT regexp_matches({t},'[a-zа-я]') THEN NULL "
    f"WHEN length({t}) >= 5 THEN left({t},5)||'*' ELSE {t} END"
)

#: (source_row, normalized, family), one row a phrase and distinct family, by joins of exploded tokens.
EXPLODED = f"""(
    WITH p AS (SELECT source_row, {norm('phrase')} AS normalized FROM {PHRASES_DOC}),
    t AS (SELECT source_row, normalized, unnest(string_split(normalized,' ')) AS t, unnest(range(len(string_split(normalized,' ')))) AS k FROM p),
    k AS (SELECT *, {_key('t')} AS key, coalesce({_key('t')}, CASE WHEN {_anchor('t')} THEN t END) AS part, list_contains({STOP},t) AS s, {_anchor('t')} AS q FROM t WHERE t <> ''),
    g AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY k) AS n FROM k WHERE k < 12 AND part IS NOT NULL),
    f AS (SELECT source_row, normalized, key AS family FROM k WHERE key IS NOT NULL
        UNION SELECT a.source_row, a.normalized, a.part||' '||b.part FROM k a JOIN k b ON a.source_row = b.source_row AND b.k = a.k + 1
            WHERE b.k < 12 AND a.part IS NOT NULL AND b.part IS NOT NULL AND NOT (a.s AND b.s)
        UNION SELECT a.source_row, a.normalized, a.part||' '||b.part FROM g a JOIN g b ON a.source_row = b.source_row AND b.n = a.n + 1 WHERE b.k - a.k <= 3
        UNION SELECT a.source_row, a.normalized, a.part||' '||b.part||' '||c.part FROM k a JOIN k b ON a.source_row = b.source_row AND b.k = a.k + 1
            JOIN k c ON a.source_row = c.source_row AND c.k = a.k + 2
            WHERE c.k < 12 AND a.part IS NOT NULL AND b.part IS NOT NULL AND c.part IS NOT NULL AND (a.q OR b.q OR c.q))
    SELECT * FROM f)"""
COUNTS = f"(SELECT family, count(*) AS occurrences FROM {EXPLODED} GROUP BY family)"
_BAND = "(SELECT CASE WHEN n <= 500 THEN 1 ELSE greatest(5, ceil(n*0.0002))::BIGINT END AS lo, CASE WHEN n <= 500 THEN 0 ELSE greatest(greatest(5, ceil(n*0.0002))::BIGINT, floor(n*0.2)::BIGINT) END AS hi FROM (SELECT count(*) AS n FROM " + PHRASES_DOC + "))"
ELIGIBLE = f"(SELECT family, occurrences FROM {COUNTS}, {_BAND} WHERE occurrences BETWEEN lo AND hi)"


def _base(spark, sf):
    return phrases_doc(spark, sf).select("source_row", normalize("phrase").alias("normalized"))


@query(f"SELECT DISTINCT t AS token, {_key('t')} AS family FROM (SELECT unnest(string_split({norm('phrase')},' ')) AS t FROM {PHRASES_DOC})")
def family_key(spark, sf):
    tokens = _base(spark, sf).select(F.explode(F.split("normalized", " ")).alias("token")).distinct()
    return tokens.withColumn("family", FF.family_key("token"))


@query(f"SELECT source_row, count(*) AS n, md5(string_agg(family, '|' ORDER BY family)) AS digest FROM {EXPLODED} GROUP BY source_row")
def phrase_families(spark, sf):
    found = _base(spark, sf).select("source_row", FF.families("normalized").alias("f")).where(F.size("f") > 0)
    return found.select("source_row", F.size("f").cast("bigint").alias("n"), F.md5(F.array_join("f", "|")).alias("digest"))


@query(f"SELECT family, occurrences FROM {COUNTS}")
def family_counts(spark, sf):
    return M.family_counts(_base(spark, sf))


@query(f"SELECT family, occurrences FROM {ELIGIBLE}")
def family_band(spark, sf):
    base = _base(spark, sf)
    return M.in_band(M.family_counts(base), base.count())


def _selected(spark, sf):
    base = _base(spark, sf)
    rows = base.count()
    counts = written(M.family_counts(base), "counts")
    return base, M.select_families(counts, rows), rows


_disc, _docs = _list(FF.DISCOVERY), _list(FF.DOCUMENTS)
_pri = f"len(list_filter(string_split(family,' '), lambda t: {_anchor("rtrim(t,'*')")})) > 0"
_spread = lambda src, limit: f"""(SELECT family, row_number() OVER (ORDER BY occurrences DESC, family) - 1 AS n, count(*) OVER () AS m, {limit} AS lim FROM {src})"""


def _rescued(src, limit):
    """Rows at even distances of rank."""
    return f"""(SELECT family FROM {_spread(src, limit)} WHERE lim > 0 AND (m <= lim OR list_contains(list_transform(range(lim),
        lambda k: CASE WHEN k = lim-1 THEN m-1 ELSE floor(k::DOUBLE*((m-1)::DOUBLE/greatest(lim-1,1)::DOUBLE))::BIGINT END), n)))"""


SELECTED = f"""(
    WITH e AS MATERIALIZED (SELECT * FROM {ELIGIBLE}),
    w AS (SELECT * FROM e WHERE NOT contains(family,' ')), s AS (SELECT * FROM e WHERE contains(family,' ')),
    lex AS (SELECT family FROM w ORDER BY CASE WHEN list_contains({_disc},family) THEN 0 ELSE 1 END, occurrences DESC, family LIMIT 48),
    lexr AS (SELECT family FROM {_rescued('(SELECT * FROM w WHERE family NOT IN (SELECT family FROM lex))', 12)}),
    doc AS (SELECT family FROM s WHERE len(list_intersect(string_split(family,' '), {_docs})) > 0 ORDER BY occurrences DESC, family LIMIT 10),
    qn AS (SELECT 20 - count(*) AS k FROM doc),
    q AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY occurrences DESC, family) AS n FROM s WHERE {_pri} AND family NOT IN (SELECT family FROM doc)), qn WHERE n <= k),
    an AS (SELECT family FROM doc UNION SELECT family FROM q),
    gn AS (SELECT greatest(0, 40 - count(*) - 8) AS k FROM an),
    g AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY occurrences DESC, family) AS n FROM s WHERE NOT ({_pri})), gn WHERE n <= k),
    head AS (SELECT family FROM an UNION SELECT family FROM g),
    strr AS (SELECT family FROM {_rescued('(SELECT * FROM s WHERE family NOT IN (SELECT family FROM head))', '(SELECT 40 - count(*) FROM head)')})
    SELECT e.family, e.occurrences FROM e WHERE family IN (SELECT family FROM lex UNION SELECT family FROM lexr UNION SELECT family FROM head UNION SELECT family FROM strr))"""


@query(f"SELECT family, occurrences, CASE WHEN contains(family,' ') THEN 'structural' ELSE 'lexical' END AS kind FROM {SELECTED}")
def family_selection(spark, sf):
    """Against SQL while no document stem has structures in the band; the choice by stems has its own test."""
    return _selected(spark, sf)[1].select("family", "occurrences", "kind")


@query(f"""SELECT family, normalized, row_number() OVER (PARTITION BY family ORDER BY md5(family||chr(1)||normalized), normalized)::INT AS place
    FROM (SELECT DISTINCT family, normalized FROM {EXPLODED} WHERE family IN (SELECT family FROM {SELECTED})) QUALIFY place <= 64""")
def family_examples(spark, sf):
    base, selected, _ = _selected(spark, sf)
    return M.family_examples(base, selected)


@query()
def family_diverse_examples(spark, sf):
    base, selected, _ = _selected(spark, sf)
    return M.diverse_examples(M.family_examples(base, selected))


@query()
def family_candidates(spark, sf):
    base, selected, rows = _selected(spark, sf)
    return M.candidates(selected, M.diverse_examples(M.family_examples(base, selected)), rows)


@query()
def family_coverage_rows(spark, sf):
    base, selected, _ = _selected(spark, sf)
    return M.coverage_rows(M.family_examples(base, selected), selected)


@query(f"""SELECT e.family, e.normalized, l.source_row FROM (SELECT family, normalized FROM (SELECT DISTINCT family, normalized FROM {EXPLODED}
        WHERE family IN (SELECT family FROM {SELECTED})) QUALIFY row_number() OVER (PARTITION BY family ORDER BY md5(family||chr(1)||normalized), normalized) <= 64) e
    JOIN (SELECT {norm('phrase')} AS normalized, max(source_row) AS source_row FROM {PHRASES_DOC} GROUP BY 1) l ON e.normalized = l.normalized""")
def family_phrase_lookup(spark, sf):
    base, selected, _ = _selected(spark, sf)
    return M.phrase_rows(M.family_examples(base, selected), base).select("family", "normalized", "source_row")
