"""The decision on literal probabilities."""

import pytest

from phrasemill.operators.clusters import assign, cluster_count, compact, family_audit
from phrasemill.operators.decide import Settings, decide, seed_decision


def run(spark, rows, **settings):
    df = spark.createDataFrame([(p, c, i, g) for p, c, i, g in rows], "normalized string, c double, i double, pg double")
    got = {r["normalized"]: r for r in decide(df, Settings(**settings), prototypes=False).collect()}
    return [got[r[0]] for r in rows]


def test_family_decides_only_near_the_boundary(spark):
    got = run(spark, [("график вакансии", 0.8, 0.2, 0.0), ("свободный график вакансии", 0.525, 0.475, 0.0), ("какой график работы", 0.2, 0.8, 0.0)], informational_families=("графи*",))
    assert [r["intent"] for r in got] == ["commercial", "informational", "informational"]
    assert [r["family_override"] for r in got] == [False, True, False] and [r["family_conflict"] for r in got] == [True, False, False]
    assert got[1]["confidence"] == pytest.approx(0.475)


def test_opposite_marker_and_family_stop_a_family(spark):
    (got,) = run(spark, [("купить график работы", 0.48, 0.52, 0.0)], informational_families=("графи*",), commercial_markers=("купит*",))
    assert got["intent"] == "commercial" and got["family_conflict"] and not got["family_override"]
    (got,) = run(spark, [("вакансия свободный график", 0.65, 0.35, 0.0)], informational_families=("графи*",), commercial_families=("вакан*",))
    assert got["intent"] == "commercial" and got["family_conflict"] and not got["family_override"]


def test_weak_questions(spark):
    (got,) = run(spark, [("можно устроиться дизайнером", 0.45, 0.55, 0.0)], informational_families=("можно*",), weak_question_markers=("можно*",))
    assert got["intent"] == "informational" and not got["informational_family"]
    (got,) = run(spark, [("где находится деталь", 0.48, 0.52, 0.0)], weak_question_markers=("где",))
    assert got["intent"] == "informational" and got["weak_without_transaction"]
    (got,) = run(spark, [("где купить деталь", 0.40, 0.60, 0.0)], weak_question_markers=("где",), commercial_markers=("купит*",))
    assert got["intent"] == "commercial" and not got["weak_without_transaction"]


def test_structures_and_context(spark):
    got = run(spark, [("какую работу выполняет водитель", 0.52, 0.48, 0.0), ("какие вакансии водителя", 0.48, 0.52, 0.0)], commercial_families=("какие* вакан*",), informational_families=("какую* работ* выпол*",), neutral_families=("водит*",))
    assert [r["intent"] for r in got] == ["informational", "commercial"]
    got = run(spark, [("где купить бампер тойота", 0.40, 0.60, 0.0), ("как снять бампер тойота", 0.52, 0.48, 0.0)], commercial_markers=("купит*",), informational_markers=("снять",), weak_question_markers=("где", "как"))
    assert [r["intent"] for r in got] == ["commercial", "informational"]


def test_unsafe_marker_does_not_decide(spark):
    (got,) = run(spark, [("где предохранитель автомобиля оптима", 0.25, 0.75, 0.0)], commercial_markers=("опт*",), weak_question_markers=("где",))
    assert got["intent"] == "informational" and not got["commercial_marker"]


def test_relevance_comes_before_intent(spark):
    got = run(spark, [("устройство работает без интернета", 0.9, 0.1, 0.8), ("x", 0.9, 0.1, 0.4), ("y", 0.9, 0.1, 0.45)])
    assert [r["intent"] for r in got] == ["garbage", "commercial", "garbage"] and [r["quarantined"] for r in got] == [False, True, False]
    assert got[0]["confidence"] == 0.8
    for r in got:
        assert r["p_commercial"] + r["p_informational"] + r["p_garbage"] == pytest.approx(1)


def test_default_informational(spark):
    got = run(spark, [("a", 0.55, 0.45, 0.0), ("b", 0.57, 0.43, 0.0)], default_intent="informational")
    assert [r["intent"] for r in got] == ["informational", "commercial"]


def test_seed_fallback(spark):
    df = spark.createDataFrame([("мусор", 0.9, 0.0, 0.5, 0.5), ("a", 0.1, 0.3, 0.5, 0.5), ("b", 0.9, 0.1, 0.6, 0.5), ("c", 0.9, 0.1, 0.5, 0.51)], "normalized string, relevant double, garbage double, commercial double, informational double")
    got = {r["normalized"]: (r["intent"], r["basis"]) for r in seed_decision(df, Settings(), (), ("мусор",)).collect()}
    assert got == {"мусор": ("garbage", "Task garbage marker"), "a": ("garbage", "Seed-based topic relevance"), "b": ("commercial", "Commercial seed similarity"), "c": ("commercial", "Ambiguous seed result")}


def test_family_audit_looks_before_the_override(spark):
    rows = [("график a", "informational", "commercial", True, False, 1), ("график b", "informational", "commercial", True, False, 2)]
    df = spark.createDataFrame([(p, p, *x) for p, *x in rows], "phrase string, normalized string, intent string, pre_family_intent string, family_conflict boolean, family_override boolean, source_row bigint")
    (got,) = family_audit(df, Settings(informational_families=("графи*",))).collect()
    assert (got["status"], got["pre_commercial"], got["conflicts"], got["expected_share"]) == ("review", 2, 2, 0.0)


def test_assignment_and_counts(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],), ([1.0, 1.0],)], "vec array<double>")
    assert [r["cluster"] for r in assign(df, {"b": [0.0, 1.0], "a": [1.0, 0.0]}).collect()] == ["a", "b", "a"]
    assert [cluster_count(n) for n in (1, 8, 200, 10_000, 1_000_000)] == [1, 2, 10, 70, 80]
    (row,) = compact(spark.createDataFrame([("x", 0.876543)], "phrase string, p_garbage double"), ["phrase", "p_garbage", "correct_intent"]).collect()
    assert tuple(row) == ("x", 0.8765, "")


@pytest.mark.parametrize("name", ["filter_intent", "policy_conflict_review", "post_audit_review", "quarantine"])
def test_filters_do_not_repeat_the_decision(spark, sf, name):
    """The optimizer wrote the hashes of the scores into the filters some hundred times."""
    from phrasemill.catalog import load

    plan = load()[0][name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 20
