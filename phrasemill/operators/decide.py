"""The two-stage decision: scores, markers, prototypes and families to an intent, as one projection of Columns.

Scores come from any model (or none): the decision reads the columns pg (garbage), c and i (conditional intents) and, where
prototypes exist, cs and is_ (similarities). Nothing here shuffles or leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits, overlaps, safe_markers


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of the decision; markers and rules are short lists on the driver."""

    default_intent: str = "commercial"
    margin: float = 0.12
    strong_margin: float = 0.02
    weak_margin: float = 0.02
    evidence_margin: float = 0.005
    family_tolerance: float = 0.05
    minimum_similarity: float = 0.55
    policy_strength: float = 0.12
    garbage_threshold: float = 0.45
    quarantine_threshold: float = 0.35
    commercial_markers: tuple[str, ...] = ()
    informational_markers: tuple[str, ...] = ()
    weak_question_markers: tuple[str, ...] = ()
    commercial_families: tuple[str, ...] = ()
    informational_families: tuple[str, ...] = ()
    neutral_families: tuple[str, ...] = ()

    def family_rules(self) -> dict[str, str]:
        """Pattern to label. A family that overlaps a weak question marker decides nothing; a later list wins over an earlier one."""
        rules: dict[str, str] = {}
        for label in ("commercial", "informational", "neutral"):
            for pattern in getattr(self, f"{label}_families"):
                if pattern := pattern.strip():
                    weak = label != "neutral" and overlaps(pattern, self.weak_question_markers)
                    rules[pattern] = "neutral" if weak else label
        return rules


def decide(df: DataFrame, s: Settings, prototypes: bool = True) -> DataFrame:
    """Adds intent, pre_family_intent, probabilities, confidence and the evidence flags; pg, c, i, cs, is_ go."""
    rules = s.family_rules()
    col, yes = F.col, lambda label: hits("normalized", [p for p, x in rules.items() if x == label])

    def flag(name: str, value: Column) -> None:
        nonlocal df
        df = df.withColumn(name, value)

    flag("informational_marker", hits("normalized", safe_markers(s.informational_markers)))
    flag("commercial_marker", hits("normalized", safe_markers(s.commercial_markers)))
    flag("weak_question", hits("normalized", s.weak_question_markers))
    flag("informational_family", yes("informational"))
    flag("commercial_family", yes("commercial"))
    im, cm, fi, fc = (col(x) for x in ("informational_marker", "commercial_marker", "informational_family", "commercial_family"))
    flag("weak_without_transaction", col("weak_question") & ~cm & ~fc)
    if prototypes:
        bounded = F.greatest(F.least(col("cs") - col("is_"), F.lit(0.2)), F.lit(-0.2)) * s.policy_strength
        flag("policy_adjustment", F.when(F.greatest("cs", "is_") >= s.minimum_similarity, bounded).otherwise(0.0))
        flag("_c", F.greatest(col("c") + col("policy_adjustment"), F.lit(1e-8)))
        flag("_i", F.greatest(col("i") - col("policy_adjustment"), F.lit(1e-8)))
        evidence = col("is_") >= col("cs") + s.evidence_margin
    else:
        flag("policy_adjustment", F.lit(0.0))
        flag("_c", col("c"))
        flag("_i", col("i"))
        evidence = F.lit(False)
    total = col("_c") + col("_i") if prototypes else F.lit(1.0)
    df = df.withColumns({"_cc": col("_c") / total, "_ii": col("_i") / total})
    cc, ii, pg = col("_cc"), col("_ii"), col("pg")
    asked = F.when(im | evidence, s.strong_margin).otherwise(s.margin)
    asked = F.when(col("weak_without_transaction"), F.least(asked, F.lit(s.weak_margin))).otherwise(asked)
    base = F.when(cc >= ii + s.margin, "commercial").otherwise("informational") if s.default_intent == "informational" else F.when(ii >= cc + asked, "informational").otherwise("commercial")
    flag("pre_family_intent", F.when(im & ~cm, "informational").when(cm & ~im, "commercial").otherwise(base))
    si, sc = ii + s.family_tolerance >= cc, cc + s.family_tolerance >= ii
    ai, ac = fi & ~fc & ~cm & si, fc & ~fi & ~im & sc
    flag("family_conflict", (fi & fc) | (fi & cm) | (fc & im) | (fi & ~si) | (fc & ~sc))
    flag("_relevant", F.when(ai, "informational").when(ac, "commercial").otherwise(col("pre_family_intent")))
    garbage = pg >= s.garbage_threshold
    flag("family_override", (col("_relevant") != col("pre_family_intent")) & (ai | ac) & ~garbage)
    flag("intent", F.when(garbage, "garbage").otherwise(col("_relevant")))
    df = df.withColumns({"p_commercial": (1.0 - pg) * cc, "p_informational": (1.0 - pg) * ii, "p_garbage": pg, "quarantined": (pg >= s.quarantine_threshold) & ~garbage})
    flag("confidence", F.when(garbage, pg).when(col("intent") == "commercial", col("p_commercial")).otherwise(col("p_informational")))
    return df.drop("_c", "_i", "_cc", "_ii", "_relevant", "pg", "c", "i", "cs", "is_")


def override_with_labels(decided: DataFrame, labels: DataFrame) -> DataFrame:
    """A reviewed label (normalized, label; one row a phrase) replaces the decision of its phrase: probability and confidence 1, no quarantine."""
    labels = labels.select("normalized", F.col("label").alias("_label"))
    joined = decided.join(labels, "normalized", "left")
    known = F.col("_label").isNotNull()
    one_hot = {f"p_{x}": F.when(known, (F.col("_label") == x).cast("double")).otherwise(F.col(f"p_{x}")) for x in ("commercial", "informational", "garbage")}
    return joined.withColumns(
        {**one_hot, "intent": F.coalesce("_label", "intent"), "confidence": F.when(known, 1.0).otherwise(F.col("confidence")), "quarantined": ~known & F.col("quarantined"), "exact_label": known}
    ).drop("_label")


def basis(decided: DataFrame) -> DataFrame:
    """Adds decision_basis: what settled the intent, an exact label first, then a family, then the policy, else the classifier."""
    return decided.withColumn(
        "decision_basis",
        F.when(F.col("exact_label"), "Reviewed label").when(F.col("family_override"), "Reviewed family").when(F.abs("policy_adjustment") >= 0.01, "Classifier and topic policy").otherwise("Classifier"),
    )


def seed_decision(df: DataFrame, s: Settings, positive: tuple[str, ...], garbage: tuple[str, ...], least_relevance: float = 0.35, garbage_margin: float = 0.05, intent_margin: float = 0.03) -> DataFrame:
    """The decision without a trained model, from similarities to seeds: columns relevant, garbage, commercial, informational."""
    col = F.col
    ph, gh = hits("normalized", positive), hits("normalized", garbage)
    ch, ih = hits("normalized", safe_markers(s.commercial_markers)), hits("normalized", safe_markers(s.informational_markers))
    steps = [
        (gh & ~ph, "garbage", "Task garbage marker", F.lit(1.0)),
        ((col("relevant") < least_relevance) & (col("garbage") >= col("relevant") + garbage_margin) & ~ph, "garbage", "Seed-based topic relevance", F.least(F.lit(1.0), col("garbage") - col("relevant") + 0.5)),
        (ch & ~ih, "commercial", "Task commercial marker", F.lit(1.0)),
        (ih & ~ch, "informational", "Task informational marker", F.lit(1.0)),
        (col("commercial") >= col("informational") + intent_margin, "commercial", "Commercial seed similarity", F.least(F.lit(1.0), col("commercial") - col("informational") + 0.5)),
        (col("informational") >= col("commercial") + intent_margin, "informational", "Informational seed similarity", F.least(F.lit(1.0), col("informational") - col("commercial") + 0.5)),
    ]
    chosen = F.lit(None)
    for test, label, why, sure in reversed(steps):
        one = F.struct(F.lit(label).alias("intent"), F.lit(why).alias("basis"), sure.alias("confidence"))
        rest = chosen if chosen is not None and test is not steps[-1][0] else F.struct(F.lit(s.default_intent).alias("intent"), F.lit("Ambiguous seed result").alias("basis"), F.lit(0.5).alias("confidence"))
        chosen = F.when(test, one).otherwise(rest)
    return df.withColumn("_d", chosen).select("*", "_d.intent", "_d.basis", "_d.confidence").drop("_d")
