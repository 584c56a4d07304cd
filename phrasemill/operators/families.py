"""Family mining: document frequency, the band of useful counts, the selection for review, examples and coverage rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.families import DECISIVE, DISCOVERY, DOCUMENTS, families, is_document, is_prioritised, is_structure

#: Sizes of the selection.
LEXICAL, LEXICAL_RESCUE = 60, 12
STRUCTURAL, STRUCTURAL_RESCUE = 40, 8
ANCHORED, DOCUMENT = 20, 10
EXAMPLE_POOL, EXAMPLES = 64, 8
COVERAGE_ROWS = 50


def exploded(df: DataFrame) -> DataFrame:
    """One row a phrase and family."""
    return df.withColumn("family", F.explode(families("normalized")))


def family_counts(df: DataFrame) -> DataFrame:
    """In how many rows each family occurs; partial counts come first, so a very common family is no hot key."""
    return exploded(df.select("normalized")).groupBy("family").agg(F.count("*").alias("occurrences"))


def band(rows: int) -> tuple[int, int]:
    """Least and greatest count of a family worth a review; an empty band for 500 rows or fewer."""
    if rows <= 500:
        return 1, 0
    least = max(5, math.ceil(rows * 0.0002))
    return least, max(least, int(rows * 0.20))


def in_band(counts: DataFrame, rows: int) -> DataFrame:
    return counts.where(F.col("occurrences").between(*band(rows)))


def _ranked(df: DataFrame, name: str, *first: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*first, F.desc("occurrences"), "family")))


def _spread(df: DataFrame, limit: int) -> DataFrame:
    """`limit` rows at even distances of rank, in double arithmetic, both ends included; all rows if there are no more.

    Rows are ranked within eight tasks' worth of candidates at most: df is what the band has left, without those already chosen.
    """
    ranked = _ranked(df, "_n").withColumn("_m", F.count("*").over(Window.partitionBy()))
    steps = F.sequence(F.lit(0), F.lit(limit - 1))
    place = lambda i: F.when(i == limit - 1, F.col("_m") - 1).otherwise(F.floor(i.cast("double") * ((F.col("_m") - 1).cast("double") / F.lit(float(max(limit - 1, 1))))))
    wanted = F.array_distinct(F.transform(steps, place))
    return ranked.where((F.col("_m") <= limit) | F.array_contains(wanted, F.col("_n").cast("bigint") - 1)).drop("_n", "_m")


def document_picks(items: list[tuple[str, int]], limit: int = DOCUMENT) -> list[str]:
    """The strongest structure of each document stem in turn, then the most frequent others. A handful of stems, so it runs on the driver."""
    ranked = sorted(items, key=lambda x: (-x[1], x[0]))
    chosen: list[str] = []
    for stem in sorted(DOCUMENTS):
        best = next((f for f, _ in ranked if stem in f.split() and f not in chosen), None)
        if best and len(chosen) < limit:
            chosen.append(best)
    return chosen + [f for f, _ in ranked if f not in chosen][: max(0, limit - len(chosen))]


def select_families(counts: DataFrame, rows: int) -> DataFrame:
    """At most 100 families for review: family, occurrences, kind, place (1, 2, ...).

    Lexical: the head, discovery vocabulary first, and a spread over the rest. Structural: documents, questions, the general head and a
    spread. Heads are bounded, so only they and counts reach the driver; the rest stays distributed.
    """
    eligible = in_band(counts, rows).withColumn("kind", F.when(is_structure(F.col("family")), "structural").otherwise("lexical"))
    head = LEXICAL - LEXICAL_RESCUE
    words, structures = eligible.where("kind = 'lexical'"), eligible.where("kind = 'structural'")
    by_count = (F.desc("occurrences"), F.col("family"))
    known = F.when(F.col("family").isin(DISCOVERY), 0).otherwise(1)

    def names(df: DataFrame, n: int, *first) -> list[str]:
        return [x["family"] for x in df.orderBy(*first, *by_count).limit(n).collect()] if n > 0 else []

    lexical = names(words, head, known)
    per_stem = Window.partitionBy("stem").orderBy(*by_count)
    # Enough candidates of each stem that the sequential choice among them is the choice among all.
    stems = structures.where(is_document(F.col("family"))).withColumn("stem", F.explode(F.array_intersect(F.split("family", " "), F.array(*map(F.lit, DOCUMENTS)))))
    pool = {x["family"]: x["occurrences"] for x in stems.withColumn("_n", F.row_number().over(per_stem)).where(F.col("_n") <= DOCUMENT + len(DOCUMENTS)).collect()}
    documents = document_picks(list(pool.items()))
    questions = names(structures.where(is_prioritised(F.col("family")) & ~F.col("family").isin(documents)), ANCHORED - len(documents))
    anchored = documents + questions
    general = names(structures.where(~is_prioritised(F.col("family"))), max(0, STRUCTURAL - len(anchored) - STRUCTURAL_RESCUE))
    structural = list(anchored) + general
    rescue = [
        [x["family"] for x in _spread(part.where(~F.col("family").isin(taken)), limit).orderBy(*by_count).collect()] if limit > 0 else []
        for part, taken, limit in ((words, lexical, LEXICAL_RESCUE), (structures, structural, STRUCTURAL - len(structural)))
    ]
    order = [*lexical, *rescue[0], *structural, *rescue[1]]
    place = F.array_position(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), F.col("family")).cast("int")
    return eligible.withColumn("place", place).where("place > 0")


def candidates(selected: DataFrame, examples: DataFrame, rows: int) -> DataFrame:
    """The review payload: id, pattern, kind, whether it may decide, priority, share and examples."""
    family = F.col("family")
    return selected.join(examples, "family", "left").select(
        F.format_string("IF%04d", "place").alias("id"),
        family.alias("pattern"),
        "kind",
        (is_structure(family) | family.isin(DECISIVE)).alias("safe_decisive_lexical"),
        F.when(family.isin(DOCUMENTS), "document_reference")
        .when(is_structure(family) & is_document(family), "document_reference_structure")
        .when(family.isin(DISCOVERY), "intent_vocabulary")
        .otherwise("frequency_coverage")
        .alias("discovery_priority"),
        "occurrences",
        (F.rint(F.col("occurrences") / max(rows, 1) * 1e6) / 1e6).alias("share"),
        "examples",
    )


def family_examples(df: DataFrame, selected: DataFrame, n: int = EXAMPLE_POOL) -> DataFrame:
    """n pseudo-random distinct phrases of each selected family: (family, normalized, place).

    The selection (100 families at most) is broadcast; rows become distinct before they are ranked.
    """
    found = exploded(df.select("normalized")).join(F.broadcast(selected.select("family")), "family").distinct()
    w = Window.partitionBy("family").orderBy(F.md5(F.concat_ws("\u0001", "family", "normalized")), "normalized")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def pick_diverse(phrases: list[str], family: str, n: int = EXAMPLES) -> list[str]:
    """Greedy farthest-first by the words and length beside the family's own; each step the phrase least like those chosen."""
    own = [t.rstrip("*") for t in family.split()]

    def context(p: str) -> frozenset[str]:
        tokens = p.split()
        rest = [t for t in tokens if not any(t.startswith(o) for o in own)]
        return frozenset([*rest, f"__length_{min(len(tokens) // 3, 3)}"])

    pool = [(p, context(p)) for p in dict.fromkeys(phrases)]
    chosen: list[tuple[str, frozenset[str]]] = []
    while pool and len(chosen) < n:
        def alike(item) -> float:
            return max((len(item[1] & c) / len(item[1] | c) for _, c in chosen), default=0.0)

        best = min(range(len(pool)), key=lambda k: (alike(pool[k]), k))
        chosen.append(pool.pop(best))
    return [p for p, _ in chosen]


def diverse_examples(pool: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """(family, examples): a group has 64 rows at most, so each is chosen from in one task."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        family = rows["family"].iloc[0]
        return pd.DataFrame({"family": [family], "examples": [pick_diverse(rows["normalized"].tolist(), family, n)]})

    return pool.groupBy("family").applyInPandas(choose, "family string, examples array<string>")


def coverage_rows(pool: DataFrame, selected: DataFrame, limit: int = COVERAGE_ROWS) -> DataFrame:
    """Phrases that cover the selected families: 4 of each document family, 2 of vocabulary, 1 of others, each phrase once, `limit` in all.

    At most 100 families of 8 examples come together in one task.
    """

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        rows = pd.concat(got, ignore_index=True) if got else pd.DataFrame()
        taken: list[tuple[str, str]] = []
        if len(rows):
            seen: set[str] = set()
            for (_, place), group in rows.sort_values(["rank", "place", "n"]).groupby(["rank", "place"], sort=True):
                quota = int(group["quota"].iloc[0])
                for phrase, family in zip(group["normalized"], group["family"], strict=True):
                    if quota and phrase not in seen and len(taken) < limit:
                        seen.add(phrase)
                        taken.append((phrase, family))
                        quota -= 1
        yield pd.DataFrame(taken, columns=["normalized", "coverage_family"])

    family = F.col("family")
    rank = F.when(is_document(family), 0).when(family.isin(DISCOVERY), 1).otherwise(2)
    quota = F.when(is_document(family), 4).when(family.isin(DISCOVERY), 2).otherwise(1)
    best = pool.where(F.col("place") <= EXAMPLES).withColumnRenamed("place", "n")
    rows = best.join(F.broadcast(selected.select("family", "place")), "family").select("normalized", "family", "place", "n", rank.alias("rank"), quota.alias("quota"))
    return rows.coalesce(1).mapInPandas(choose, "normalized string, coverage_family string")


def phrase_rows(pool: DataFrame, phrases: DataFrame) -> DataFrame:
    """The row of each phrase, the last one where a phrase occurs more than once."""
    last = phrases.groupBy("normalized").agg(F.max("source_row").alias("source_row"))
    return pool.join(last, "normalized")
