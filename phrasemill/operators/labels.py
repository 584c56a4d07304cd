"""Label sheets: loading, applying, quality, coverage of signals, pages to review, seeds and the knowledge store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, hits, label_of, marker_text, normalize, rounded, unsafe_reason

AUXILIARY = ("model_reviewed", "review_corrected")
#: How many entries the lists of a policy need.
LEAST_POLICY = {"commercial_prototypes": 3, "implicit_commercial_prototypes": 5, "informational_prototypes": 5, "commercial_signals": 5, "informational_signals": 12, "weak_question_signals": 3, "relevant_prototypes": 5, "garbage_prototypes": 5}
#: How many rows a review needs.
PRIORITY_ROWS, LEAST_LABELS, LEAST_EXAMPLES, LEAST_SEEDS = 50, 150, 3, 5


def with_label(sheet: DataFrame) -> DataFrame:
    """Adds label (or null), phrase trimmed, confidence null outside 0 to 1."""
    sure = F.when(F.col("model_confidence").between(0.0, 1.0), F.col("model_confidence"))
    return sheet.withColumns({"phrase": F.trim(F.coalesce("phrase", F.lit(""))), "label": label_of("model_label"), "confidence": sure})


def last_wins(sheet: DataFrame) -> DataFrame:
    """Valid labels, one row a normalised phrase: the last one by source_row."""
    rows = with_label(sheet).where("label is not null and phrase <> ''").withColumn("normalized", normalize("phrase"))
    source = F.coalesce(F.nullif("knowledge_source", F.lit("")), F.lit("current representative sample"))
    return rows.groupBy("normalized").agg(F.max_by(F.struct("phrase", "label", "model_notes", source.alias("knowledge_source"), "source_row"), "source_row").alias("x")).select("normalized", "x.*")


def reviewed() -> Column:
    """With the columns of with_label: a valid label and a confidence."""
    return F.col("label").isNotNull() & F.col("confidence").isNotNull()


def apply_labels(sheet: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (sample_id, label, confidence, notes) replace what the sheet has; one update an id, unknown ids change nothing."""
    u = updates.select("sample_id", F.col("label").alias("_l"), F.col("confidence").alias("_c"), F.col("notes").alias("_n"))
    return sheet.join(u, "sample_id", "left").withColumns({"model_label": F.coalesce("_l", "model_label"), "model_confidence": F.coalesce("_c", "model_confidence"), "model_notes": F.coalesce("_n", "model_notes")}).drop("_l", "_c", "_n")


def conflicts(sheet: DataFrame) -> DataFrame:
    """Phrases with more than one label."""
    key = F.regexp_replace(folded("phrase"), r"\s+", " ")
    rows = with_label(sheet).where("label is not null and phrase <> ''").select(key.alias("phrase_key"), "label")
    return rows.groupBy("phrase_key").agg(F.count_distinct("label").alias("labels")).where("labels > 1")


def quality(sheet: DataFrame, positive: tuple[str, ...] = ()) -> DataFrame:
    """One row of measures of a label sheet."""
    rows = with_label(sheet)
    blank, invalid = F.col("phrase") == "", (F.trim("model_label") != "") & F.col("label").isNull()
    labelled = F.col("label").isNotNull() & ~blank
    low = F.col("confidence") < 0.70
    garbage = (F.col("label") == "garbage") & F.exists(F.array(*map(F.lit, positive)), lambda m: F.contains(folded("phrase"), m)) if positive else F.lit(False)
    one = rows.agg(
        F.count_if(~blank).alias("sample_rows"),
        F.count_if(labelled).alias("valid_labeled_rows"),
        *(F.count_if(F.col("label") == x).alias(f"{x}_rows") for x in ("commercial", "informational", "garbage")),
        F.count_if(invalid).alias("invalid_labels"),
        F.count_if(labelled & F.col("confidence").isNotNull()).alias("confidence_complete_rows"),
        F.count_if(labelled & F.col("confidence").isNull()).alias("missing_or_invalid_confidence"),
        F.count_if(labelled & low).alias("_low"),
        F.count_if(labelled & low & (F.col("model_notes") == "")).alias("low_confidence_without_notes"),
        F.least(F.lit(10), F.count_if(garbage)).alias("positive_marker_garbage_conflicts"),
    )
    top = rows.orderBy(F.desc(F.col("search_volume") + F.col("occurrences")), "source_row").limit(PRIORITY_ROWS)
    unreviewed = top.agg(F.count_if(~(labelled & F.col("confidence").isNotNull())).alias("high_priority_unreviewed"))
    disagreeing = conflicts(sheet).agg(F.count("*").alias("conflicting_duplicate_labels"))
    out = one.join(F.broadcast(unreviewed)).join(F.broadcast(disagreeing))
    return out.withColumns(
        {
            "required_labeled_rows": F.least(F.lit(LEAST_LABELS), "sample_rows"),
            "garbage_share": rounded(F.col("garbage_rows") / F.greatest("valid_labeled_rows", F.lit(1)), 6),
            "low_confidence_share": rounded(F.col("_low") / F.greatest("confidence_complete_rows", F.lit(1)), 6),
            "intent_coverage_target": F.least(F.lit(30), F.greatest(F.lit(LEAST_EXAMPLES), F.floor((F.col("valid_labeled_rows") + 9) / 10))),
        }
    ).drop("_low")


def messages(m: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a row of quality()."""
    errors, warnings = [], []
    if m["valid_labeled_rows"] < m["required_labeled_rows"]:
        errors.append(f"{m['valid_labeled_rows']} valid labels of {m['required_labeled_rows']} required")
    for name in ("invalid_labels", "missing_or_invalid_confidence", "high_priority_unreviewed", "positive_marker_garbage_conflicts"):
        if m[name]:
            errors.append(f"{name}: {m[name]}")
    for x in ("commercial", "informational"):
        if m[f"{x}_rows"] < LEAST_EXAMPLES:
            errors.append(f"{x}: {m[f'{x}_rows']} examples of {LEAST_EXAMPLES} required")
        elif m[f"{x}_rows"] < m["intent_coverage_target"]:
            warnings.append(f"{x}: fewer than {m['intent_coverage_target']} examples")
    if 0 < m["garbage_rows"] < LEAST_EXAMPLES:
        warnings.append(f"garbage: only {m['garbage_rows']} examples")
    for name in ("conflicting_duplicate_labels", "low_confidence_without_notes"):
        if m[name]:
            warnings.append(f"{name}: {m[name]}")
    if m["confidence_complete_rows"] >= 30 and m["low_confidence_share"] > 0.30:
        warnings.append(f"share of low confidence: {m['low_confidence_share']}")
    if m["garbage_share"] > 0.40:
        warnings.append(f"share of garbage: {m['garbage_share']}")
    return errors, warnings


def signal_coverage(rows: DataFrame, commercial: tuple, informational: tuple, weak: tuple = ()) -> DataFrame:
    """One row: how well signals cover the labels and how often they hit the other one. rows: (phrase, label); punctuation counts."""
    text = folded("phrase")
    marked = rows.select("label", hits(text, commercial).alias("c"), hits(text, informational).alias("i"), hits(text, weak).alias("w"))
    com, inf = F.col("label") == "commercial", F.col("label") == "informational"
    share = lambda hit, among: F.coalesce(F.avg(F.when(among, hit.cast("double"))), F.lit(0.0))
    c, i, w = F.col("c"), F.col("i"), F.col("w")
    one = marked.agg(
        F.count_if(com).alias("commercial_examples"),
        F.count_if(inf).alias("informational_examples"),
        share(c, com).alias("cc"),
        share(i, inf).alias("ic"),
        share(i & ~c, com).alias("ifp"),
        share(c & ~i, inf).alias("cfp"),
        F.count_if(w & inf).alias("weak_informational_examples"),
        F.count_if(w & com).alias("weak_commercial_examples"),
        share(i, w & inf).alias("wi"),
        share(c, w & com).alias("wc"),
    )
    eligible = (F.col("commercial_examples") >= 30) & (F.col("informational_examples") >= 30)
    needs = (F.col("ic") < 0.55) | (F.col("ifp") > 0.15) | (F.col("cfp") > 0.15) | ((F.col("weak_informational_examples") >= 5) & (F.col("wi") < 0.5)) | ((F.col("weak_commercial_examples") >= 5) & (F.col("wc") < 0.5))
    names = {"cc": "commercial_coverage", "ic": "informational_coverage", "ifp": "informational_false_positive", "cfp": "commercial_false_positive", "wi": "weak_informational_coverage", "wc": "weak_commercial_coverage"}
    score = 0.5 * (F.col("cc") + F.col("ic")) - 0.75 * (F.col("ifp") + F.col("cfp"))
    return one.select("commercial_examples", "informational_examples", "weak_informational_examples", "weak_commercial_examples", *(rounded(k, 4).alias(v) for k, v in names.items()), eligible.alias("eligible"), (eligible & needs).alias("needs_refinement"), rounded(score, 4).alias("quality_score"))


def policy_guard(baseline: dict, candidate: dict) -> tuple[bool, list[str]]:
    """Whether changed signals may replace the old ones: no worse in score by more than 0.02, false hits at most 0.20 or 0.03 more than before."""
    if not candidate["eligible"]:
        return False, ["not_enough_reviewed_intent_examples"]
    reasons = ["signal_quality_score_regressed"] if candidate["quality_score"] + 0.02 < baseline["quality_score"] else []
    for k in ("informational_false_positive", "commercial_false_positive"):
        if candidate[k] > max(0.20, baseline[k] + 0.03):
            reasons.append(f"{k}_regressed")
    return not reasons, reasons


def sanitize(rows: DataFrame, signals: tuple[str, ...], expected: str) -> DataFrame:
    """(signal, reason or null, expected_examples, opposite_examples): unsafe wildcards and signals that the other label shares are rejected."""
    other = {"commercial": "informational", "informational": "commercial"}[expected]
    text = folded("phrase")
    sums = rows.agg(*[x for k, s in enumerate(signals) for x in (F.count_if(hits(text, [s]) & (F.col("label") == expected)).alias(f"e{k}"), F.count_if(hits(text, [s]) & (F.col("label") == other)).alias(f"o{k}"))])
    unsafe = [unsafe_reason(s) for s in signals]
    items = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(u).cast("string").alias("unsafe"), F.col(f"e{k}").alias("expected_examples"), F.col(f"o{k}").alias("opposite_examples")) for k, (s, u) in enumerate(zip(signals, unsafe, strict=True))])
    out = sums.select(F.inline(items))
    n = F.col("expected_examples") + F.col("opposite_examples")
    collides = (n >= 4) & (F.col("opposite_examples") >= 2) & (F.col("opposite_examples") / n >= 0.30)
    return out.select("signal", F.coalesce("unsafe", F.when(collides, "reviewed_label_collision")).alias("reason"), "expected_examples", "opposite_examples")


def bootstrap_seeds(rows: DataFrame, n: int = LEAST_SEEDS) -> DataFrame:
    """(seed_list, place, phrase): the first distinct phrases of each class, in order of source_row."""
    key = F.trim(F.regexp_replace(folded("phrase"), r"\s+", " "))
    relevant = F.col("label").isin("commercial", "informational")
    lists = F.array_compact(F.array(F.when(relevant, "topic.relevant_seeds"), F.when(F.col("label") == "commercial", "intent.commercial_seeds"), F.when(F.col("label") == "informational", "intent.informational_seeds"), F.when(F.col("label") == "garbage", "topic.garbage_seeds")))
    first = rows.where("phrase <> ''").withColumn("seed_list", F.explode(lists)).groupBy("seed_list", key.alias("k")).agg(F.min(F.struct("source_row", "phrase")).alias("x"))
    w = Window.partitionBy("seed_list").orderBy("x.source_row")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("seed_list", "place", F.col("x.phrase").alias("phrase"))


def family_rules(candidates: DataFrame, decisions: DataFrame, weak: tuple[str, ...]) -> DataFrame:
    """(id, pattern, label): reviewed decisions, forced to neutral where the family overlaps a weak signal or may not decide."""
    forms = candidates.select("id", "pattern", "kind", "safe_decisive_lexical").join(decisions, "id")
    # The overlap is that of the marker functions, as expressions over the short list of weak signals.
    stem = F.rtrim("pattern", F.lit("*"))
    parts = [t.rstrip("*") for s in weak for t in s.split() if t.rstrip("*")]
    weakly = F.exists(F.array(*map(F.lit, parts)), lambda t: F.startswith(stem, t) | F.startswith(t, stem)) if parts else F.lit(False)
    forced = (F.col("label") != "neutral") & (weakly | ((F.col("kind") == "lexical") & ~F.col("safe_decisive_lexical")))
    return forms.select("id", "pattern", F.when(forced, "neutral").otherwise(F.col("label")).alias("label"), forced.alias("forced"))


# -- pages of rows to review --------------------------------------------------------------------------------------------------


def sample_page(sheet: DataFrame, offset: int, limit: int, labeled: bool = False) -> DataFrame:
    """Unlabelled rows by volume, or all rows."""
    rows = with_label(sheet).where("phrase <> ''" if labeled else "label is null and phrase <> ''")
    return rows.orderBy(F.desc("search_volume"), "sample_id").offset(offset).limit(limit)


def priority_review(sheet: DataFrame) -> DataFrame:
    """Of the 50 rows of most volume and occurrences, those not reviewed."""
    top = with_label(sheet).orderBy(F.desc(F.col("search_volume") + F.col("occurrences")), "source_row").limit(PRIORITY_ROWS)
    return top.where(~reviewed())


def family_review(sheet: DataFrame, limit: int) -> DataFrame:
    """Rows sampled for a family that are not reviewed, by family."""
    return with_label(sheet).where((F.col("coverage_family") != "") & ~reviewed()).orderBy("coverage_family", "sample_id").limit(limit)


def family_status(sheet: DataFrame) -> DataFrame:
    rows = with_label(sheet).where("coverage_family <> ''")
    return rows.agg(F.count("*").alias("total"), F.count_if(reviewed()).alias("reviewed"), F.count_if(~reviewed()).alias("remaining"))


def current_counts(sheet: DataFrame) -> DataFrame:
    """Labels of this job's own rows, without those taken over from knowledge."""
    own = with_label(sheet).where((F.col("phrase") != "") & ~F.lower(F.trim(F.coalesce("knowledge_source", F.lit("")))).isin(*AUXILIARY))
    return own.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def merge_prior(prior: DataFrame, current: DataFrame, limit: int) -> DataFrame:
    """Labelled rows of an earlier sample first, then the current one; one row a phrase, `limit` in all."""
    both = prior.withColumn("turn", F.lit(0)).unionByName(current.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("normalized").orderBy("turn", "source_row")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("turn", "source_row").limit(limit)


def policy_context(rows: DataFrame, weak: tuple[str, ...], n: int) -> DataFrame:
    """(group, label, place, phrase): the n phrases of most volume of each label, and of those with a weak question word."""
    groups = F.array_compact(F.array(F.lit("examples"), F.when(hits(folded("phrase"), weak) & (F.col("label") != "garbage"), "weak_question")))
    w = Window.partitionBy("group", "label").orderBy(F.desc("search_volume"), "source_row")
    return rows.where("label is not null and phrase <> ''").withColumn("group", F.explode(groups)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("group", "label", "place", "phrase")


# -- knowledge -------------------------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Examples after new ones: (topic_key, phrase_key, phrase, label, confidence, verification, source_job, seq).

    Phrase, label and job are the latest; confidence is the largest ever, within 0 to 1; verification is the oldest, but corrected once any
    later row is. seq orders rows, so repeats within one batch fold in their order too.
    """
    rows = old.unionByName(new).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    return rows.groupBy("topic_key", "phrase_key").agg(
        F.max_by("phrase", "seq").alias("phrase"),
        F.max_by("label", "seq").alias("label"),
        F.max("confidence").alias("confidence"),
        F.when(F.bool_or(F.col("verification") == "review_corrected"), "review_corrected").otherwise(F.min_by("verification", "seq")).alias("verification"),
        F.max_by("source_job", "seq").alias("source_job"),
        F.max("seq").alias("seq"),
    )


def upsert_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Topic profiles (topic_key, profile, seq): the latest of each topic."""
    rows = old.unionByName(new)
    return rows.groupBy("topic_key").agg(F.max_by("profile", "seq").alias("profile"), F.max("seq").alias("seq"))


def balanced(examples: DataFrame, topic: str, limit: int) -> DataFrame:
    """Of each label a third of the limit, by confidence and recency."""
    w = Window.partitionBy("label").orderBy(F.desc("confidence"), F.desc("seq"), "phrase_key")
    return examples.where(F.col("topic_key") == topic).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, limit // 3))


def knowledge_status(examples: DataFrame) -> DataFrame:
    return examples.groupBy("topic_key", "label", "verification").agg(F.count("*").alias("n"))


def knowledge_topics(topics: DataFrame, examples: DataFrame) -> DataFrame:
    n = examples.groupBy("topic_key").agg(F.count("*").alias("n"))
    return topics.join(n, "topic_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def forget(examples: DataFrame, topic: str) -> DataFrame:
    return examples.where(F.col("topic_key") != topic)


def import_feedback(sheet: DataFrame, corrections: DataFrame) -> DataFrame:
    """The sheet with valid corrections added; of rows with the same phrase in lower case the last stays, corrections coming last."""
    new = corrections.withColumn("label", label_of("correct_intent")).where("label is not null and trim(phrase) <> ''")
    rows = sheet.select(F.trim("phrase").alias("phrase"), "model_label", F.lit(0).alias("turn"), "source_row").unionByName(new.select(F.trim("phrase").alias("phrase"), F.col("label").alias("model_label"), F.lit(1).alias("turn"), "source_row"))
    last = rows.groupBy(F.lower("phrase").alias("phrase_key")).agg(F.max_by(F.struct("phrase", "model_label", "turn"), F.struct("turn", "source_row")).alias("x"))
    return last.select("phrase_key", "x.*")


def signal_overlap(commercial: tuple[str, ...], informational: tuple[str, ...]) -> list[str]:
    """Signals that both lists have, in the form that markers take: lower case without punctuation."""
    return sorted({marker_text(s) for s in commercial} & {marker_text(s) for s in informational} - {""})


def folded_key(text: str) -> str:
    return " ".join(text.lower().replace("ё", "е").split())


def apply_policy(rows: DataFrame, lists: dict[str, list[str]], baseline: dict | None = None) -> dict:
    """Checks lists of signals and prototypes before they are used; raises ValueError where they are too few or overlap.

    Returns the lists without unsafe signals, what was rejected, and the coverage; with a baseline the guard decides. Repeats within a list count
    once, and weak questions that are also strong signals are left out.
    """
    lists = {name: list({folded_key(v): v for v in reversed(values) if v.strip()}.values())[::-1] for name, values in lists.items()}
    strong = {marker_text(s) for name in ("commercial_signals", "informational_signals") for s in lists.get(name, [])}
    lists["weak_question_signals"] = [s for s in lists.get("weak_question_signals", []) if marker_text(s) not in strong]
    for name, least in LEAST_POLICY.items():
        if len(lists.get(name, [])) < least:
            raise ValueError(f"{name}: {least} at least")
    if both := signal_overlap(tuple(lists["commercial_signals"]), tuple(lists["informational_signals"])):
        raise ValueError(f"signals in both lists: {both}")
    out, rejected = dict(lists), []
    for name, label in (("commercial_signals", "commercial"), ("informational_signals", "informational")):
        checked = sanitize(rows, tuple(lists[name]), label).collect()
        out[name] = [r["signal"] for r in checked if r["reason"] is None]
        rejected += [r.asDict() for r in checked if r["reason"]]
    coverage = signal_coverage(rows, tuple(out["commercial_signals"]), tuple(out["informational_signals"]), tuple(lists["weak_question_signals"])).first().asDict()
    safe, reasons = policy_guard(baseline, coverage) if baseline else (True, [])
    return {"lists": out, "rejected": rejected, "coverage": coverage, "accepted": safe, "reasons": reasons}


