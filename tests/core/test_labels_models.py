"""Label sheets, knowledge, calibration, clusters and the next step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.operators import labels as L
from phrasemill.operators import models as M
from phrasemill.operators.features import HashedGrams, char_grams
from phrasemill.plans.next_action import Facts, next_action

SHEET = "sample_id string, source_row bigint, phrase string, model_label string, model_confidence double, model_notes string, knowledge_source string, coverage_family string, search_volume double, occurrences bigint"


def sheet(spark, rows):
    return spark.createDataFrame([(f"row-{k:06d}", k, p, x, c, "", s, f, 0.0, 1) for k, (p, x, c, s, f) in enumerate(rows)], SHEET)


def test_colliding_signal_is_rejected(spark):
    rows = spark.createDataFrame([("работа a", "commercial"), ("работа b", "commercial"), ("работа c", "informational"), ("работа d", "informational")], "phrase string, label string")
    got = {r["signal"]: r["reason"] for r in L.sanitize(rows, ("работа", "опт*", "другое"), "commercial").collect()}
    assert got == {"работа": "reviewed_label_collision", "опт*": "wildcard_stem_too_short", "другое": None}


def test_policy_guard():
    base = {"eligible": True, "quality_score": 0.40, "informational_false_positive": 0.05, "commercial_false_positive": 0.04}
    assert L.policy_guard(base, base | {"quality_score": 0.38, "informational_false_positive": 0.24}) == (False, ["informational_false_positive_regressed"])
    assert L.policy_guard(base, base) == (True, [])
    assert L.policy_guard(base, base | {"eligible": False})[0] is False


def test_saved_knowledge_does_not_count(spark):
    s = sheet(spark, [("a", "commercial", 0.9, "current representative sample", ""), ("b", "commercial", 0.9, "review_corrected", ""), ("c", "informational", 0.9, "model_reviewed", "")])
    assert {r["label"]: r["n"] for r in L.current_counts(s).collect()} == {"commercial": 1}


def test_last_label_wins_and_blank_is_no_label(spark):
    s = sheet(spark, [("A!", "мусор", 0.9, "x", ""), ("a", "commercial", 0.9, "", ""), ("b", "", None, "x", ""), (None, "garbage", 1.0, "x", "")])
    (got,) = L.last_wins(s).collect()
    assert (got["normalized"], got["label"], got["knowledge_source"]) == ("a", "commercial", "current representative sample")


def test_knowledge_folds_in_order(spark):
    kind = "topic_key string, phrase_key string, phrase string, label string, confidence double, verification string, source_job string, seq bigint"
    old = spark.createDataFrame([("t", "a", "A", "garbage", 0.9, "model_reviewed", "j1", 1)], kind)
    new = spark.createDataFrame([("t", "a", "a", "commercial", 0.5, "review_corrected", "j2", 2), ("t", "a", "aa", "informational", 7.0, "model_reviewed", "j3", 3)], kind)
    (got,) = L.upsert(old, new).collect()
    assert (got["phrase"], got["label"], got["confidence"], got["verification"], got["source_job"]) == ("aa", "informational", 1.0, "review_corrected", "j3")


def test_calibration_falls_back_without_examples(spark):
    few = spark.createDataFrame([("garbage", 0.9)] * 3 + [("relevant", 0.1)] * 30, "label string, pg double")
    got = M.calibrate(few).first()
    assert (got["garbage_threshold"], got["quarantine_threshold"], got["calibrated"]) == (0.45, 0.35, False)
    many = spark.createDataFrame([("garbage", 0.9)] * 10 + [("relevant", 0.1)] * 30, "label string, pg double")
    got = M.calibrate(many).first()
    assert got["calibrated"] and got["garbage_threshold"] == pytest.approx(0.60) and got["recall"] == 1.0


def test_two_stage_fit_separates(spark):
    rng = np.random.default_rng(0)
    rows = [([float(k == 0), float(k == 1), float(k == 2), *rng.normal(0, 0.1, 2).tolist()], ("commercial", "informational", "garbage")[k], 1.0) for k in range(3) for _ in range(20)]
    df = spark.createDataFrame(rows, "vec array<double>, label string, weight double")
    relevance, intent = M.fit_two_stage(df)
    got = M.probability(M.probability(df, relevance, "pg"), intent, "c").groupBy("label").agg(F.avg("pg").alias("pg"), F.avg("c").alias("c")).collect()
    means = {r["label"]: r for r in got}
    assert means["garbage"]["pg"] > 0.6 > 0.4 > means["commercial"]["pg"] and means["commercial"]["c"] > 0.6 > means["informational"]["c"]
    with pytest.raises(ValueError):
        M.fit_two_stage(df.limit(10))


def test_density_clusters_find_blobs():
    rng = np.random.default_rng(1)
    centres = np.eye(3)
    x = np.concatenate([c + rng.normal(0, 0.05, (40, 3)) for c in centres] + [rng.normal(0, 1, (10, 3))])
    label, member = M.hdbscan(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    blobs = [np.bincount(label[k * 40 : k * 40 + 40] + 1).argmax() - 1 for k in range(3)]
    assert len(set(blobs)) == 3 and -1 not in blobs
    assert ((member >= 0) & (member <= 1)).all()


def test_density_clusters_of_large_groups(spark):
    """6,000 rows a group, which were refused: as many tight blobs as were made, also in memory that does not grow with the square of the rows."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(0, 0.02, (1500, 4)) for c in np.eye(4)])
    got = M.density_clusters(spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(x)], "id int, side int, vec array<double>"), "side", least=20).collect()
    label = {r["id"]: r["density_cluster"] for r in got}
    main = [np.bincount([label[k] + 1 for k in range(b * 1500, b * 1500 + 1500)]).argmax() - 1 for b in range(4)]
    assert len(got) == 6000 and len(set(main)) == 4 and -1 not in main
    tracemalloc.start()
    M.hdbscan(x / np.linalg.norm(x, axis=1, keepdims=True), 20)
    assert tracemalloc.get_traced_memory()[1] < 6000 * 6000 * 8 / 2
    tracemalloc.stop()


def test_grams(spark):
    got = spark.createDataFrame([("Ab abcd",), ("",)], "t string").select(char_grams(F.col("t"))).collect()
    assert sorted(got[0][0]) == sorted([" ab", "ab ", " ab ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "]) and got[1][0] == []
    v = HashedGrams(64).encode(["abc", "abc", "", "zzz"])
    assert np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v[0]), 1) and not v[2].any()


READY = dict(reviewed=600, total=800, source_total=20_000, garbage=40, own={"commercial": 200, "informational": 200}, policy={k: 30 for k in ("commercial_prototypes", "implicit_commercial_prototypes", "informational_prototypes", "commercial_signals", "informational_signals", "weak_question_signals", "relevant_prototypes", "garbage_prototypes")}, audits=6, yields=[3, 1], intent_audits=2, policy_audits=1, attempts=1, checked_at=600)


@pytest.mark.parametrize("change,expected", [
    ({}, ("continue", "run-auto")), ({"running": True}, ("running", "wait")), ({"stage": "finalized"}, ("stop", "report")), ({"inspected": False}, ("blocked", "report")),
    ({"reviewed": 100}, ("continue", "sample")), ({"own": {"commercial": 12, "informational": 414}, "total": 600}, ("blocked", "report")), ({"own": {"commercial": 12}}, ("continue", "sample")),
    ({"priority": 3}, ("continue", "priority-review")), ({"families": 4}, ("continue", "family-review")), ({"coverage": 1}, ("continue", "family-coverage-review")), ({"policy": {}}, ("continue", "policy-context")),
    ({"audits": 2}, ("continue", "relevance-review")), ({"intent_audits": 1}, ("continue", "intent-review")), ({"policy_audits": 0}, ("continue", "policy-conflict-review")), ({"reviewed": 400, "checked_at": 400}, ("continue", "review")),
    ({"errors": ["x"]}, ("blocked", "report")), ({"checked_at": 0}, ("continue", "policy-context")), ({"source_total": 400, "total": 600}, ("continue", "run-auto")), ({"stage": "cluster_relevance_review", "clusters": 2}, ("continue", "cluster-review")),
])
def test_next_action(change, expected):
    got = next_action(Facts(**(READY | change)))
    assert (got["status"], got["action"]) == expected
