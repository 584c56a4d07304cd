"""Text functions, markers and families on literals."""

import random

import pytest
from pyspark.sql import functions as F

from phrasemill.functions import text as T
from phrasemill.functions.families import families
from phrasemill.operators import families as M


def values(spark, rows, kind, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column).collect()]


def test_normalize(spark):
    rows = ["  Ёлка-2 ", "Купить!! ПЫЛЕСОС", "--", None, "été x", "a\tb"]
    assert values(spark, rows, "string", T.normalize("x")) == ["елка 2", "купить пылесос", "", None, "t x", "a b"]
    assert values(spark, rows, "string", T.topic_key("x")) == ["елка-2", "купить-пылесос", "topic", "topic", "t-x", "a-b"]
    assert values(spark, ["ab " * 60], "string", F.char_length(T.slugify("x"))) == [80]


def test_labels_and_numbers(spark):
    assert values(spark, [" Мусор ", "transactional", "x", None, ""], "string", T.label_of("x")) == ["garbage", "commercial", None, None, None]
    assert values(spark, ["1.5", "x", None], "string", T.number("x")) == [1.5, 0.0, 0.0]
    assert values(spark, [0.876543, 0.00005, None], "double", T.rounded("x", 4)) == [0.8765, 0.0, None]


@pytest.mark.parametrize("text,markers,hit", [
    ("купить деталь", ["купит*"], True), ("накупить", ["купит*"], False), ("где купить деталь", ["купить деталь"], True),
    ("оптима", ["опт*"], True), ("купить!", ["купить"], False), ("x", [], False), ("x", ["  "], False), ("a.b", ["a.b"], False),
])
def test_marker_hits(spark, text, markers, hit):
    assert values(spark, [text], "string", T.hits(F.col("x"), markers)) == [hit]


def test_marker_safety(spark):
    cases = {"опт*": "wildcard_stem_too_short", "купит*": None, "": "empty", "на опт* x": "wildcard_stem_too_short", "опт": None, "!!": "empty"}
    assert {m: T.unsafe_reason(m) for m in cases} == cases
    assert values(spark, list(cases), "string", T.unsafe_reason_column("x")) == list(cases.values())
    assert T.safe_markers(list(cases)) == ["купит*", "опт"]


def test_overlap():
    assert T.overlaps("можно*", ["можно*"]) and T.overlaps("водит*", ["как водить"]) and not T.overlaps("график*", ["где", "как"]) and not T.overlaps("*", ["где"])


def test_inline_entries(spark):
    got = values(spark, ["a|commercial|0.9; b | garbage |1;x|y;;|a|b"], "string", T.inline_fields("x", 3))
    assert got == [[["a", "commercial", "0.9"], ["b", "garbage", "1"]]]
    assert values(spark, ["Buy;  buy now ; BUY;x"], "string", T.policy_list("x", 2)) == [["Buy", "buy now"]]


def test_phrase_families(spark):
    got = values(spark, ["какую работу выполняет водитель", "заявление на работу бухгалтером", "", "и на", "12345 год"], "string", families("x"))
    assert {"какую* работ*", "какую* работ* выпол*", "работ* выпол*", "выпол* водит*"} <= set(got[0])
    assert "заявл* работ*" in got[1]
    assert got[2] == got[3] == [] and got[4] == []


def test_diverse_examples_do_not_depend_on_order():
    phrases = ["график работы", "свободный график", "график отпусков", "график дежурств на месяц", "гибкий график работы", "график платежей по кредиту", "сменный график", "график функции", "скользящий график", "график сессии"]
    first = M.pick_diverse(sorted(phrases), "графи*")
    assert len(first) == 8 and len(set(first)) == 8
    assert first == M.pick_diverse(sorted(random.Random(1).sample(phrases, 10)), "графи*")


def test_document_families_keep_their_place(spark):
    counts = [(f"слово{i}*", 10_000 - i) for i in range(100)] + [(f"часто{i}* слово{i}*", 8_000 - i) for i in range(60)] + [("заявл*", 161), ("заявл* работ*", 56)]
    chosen = {r["family"] for r in M.select_families(spark.createDataFrame(counts, "family string, occurrences bigint"), 151_662).collect()}
    assert {"заявл*", "заявл* работ*"} <= chosen and len(chosen) == 100
    assert M.select_families(spark.createDataFrame(counts, "family string, occurrences bigint"), 500).count() == 0


def test_document_picks_take_each_stem_once():
    items = [("заявл* работ*", 9), ("заявл* отпус*", 8), ("резюм* работ*", 3), ("анкет* резюм*", 2)]
    assert M.document_picks(items, 3) == ["анкет* резюм*", "заявл* работ*", "резюм* работ*"]
    assert M.document_picks(items, 10) == ["анкет* резюм*", "заявл* работ*", "резюм* работ*", "заявл* отпус*"]


def test_coverage_rows(spark):
    pool = [("заявл*", f"заявление {i}", i + 1) for i in range(8)] + [("отзыв*", f"отзывы {i}", i + 1) for i in range(8)] + [("слово*", "заявление 0", 1), ("слово*", "слово 1", 2)]
    selected = spark.createDataFrame([("заявл*", 1), ("отзыв*", 2), ("слово*", 3)], "family string, place int")
    got = M.coverage_rows(spark.createDataFrame(pool, "family string, normalized string, place int"), selected).collect()
    assert [(r["coverage_family"]) for r in got] == ["заявл*"] * 4 + ["отзыв*"] * 2 + ["слово*"]
    assert got[-1]["normalized"] == "слово 1"


def test_normalize_searches_for_what_stays(spark):
    odd = ["a  b", " -a_b- ", "ʼтест́ ё̈", "ЯяЁ№5", "\u2003x\u00a0y", "ſK", "\U0001f600q"]
    plain = F.trim(F.regexp_replace(F.translate(F.lower("x"), "ё", "е"), "[^a-zа-я0-9]+", " "))
    df = spark.createDataFrame([(x,) for x in [*odd, None, ""]], "x string").select(T.normalize("x").alias("got"), plain.alias("want"))
    assert all(r["got"] == r["want"] for r in df.collect())
    # The complement of several ranges takes ten times as long.
    assert "[^" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_streamed_family_counts_add_up_without_state(spark, tmp_path):
    from phrasemill.streaming import chunks as S

    rows = [(f"words {'again' if i % 2 else 'other'} {i % 7}", 0.0, i) for i in range(40)]
    df = spark.createDataFrame(rows, S.SCHEMA)
    df.repartitionByRange(4, "source_row").write.parquet(f"{tmp_path}/in")
    S.write_family_counts(S.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r["family"]: r["occurrences"] for r in S.added_family_counts(spark, f"{tmp_path}/out").collect()}
    assert got == {r["family"]: r["occurrences"] for r in M.family_counts(df.withColumn("normalized", T.normalize("phrase"))).collect()}
    assert got["words*"] == 40 and not (tmp_path / "check" / "state").exists()
