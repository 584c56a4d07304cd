"""Files, workbooks, streams, job folders and a job from its file to its result."""

import json

import pytest
from pyspark.sql import functions as F

from phrasemill.__main__ import execute, parser
from phrasemill.operators import labels as L
from phrasemill.plans.state import Job, check_config, flatten, latest_version, next_version
from phrasemill.plans.workflow import Workflow
from phrasemill.sources import delimited as D
from phrasemill.sources import files
from phrasemill.sources.workbooks import find_sheet, read_workbook, write_workbook
from phrasemill.streaming.chunks import Progress, read_stream, write_parts, write_reservoir


@pytest.mark.parametrize("encoding,name", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8-sig"), ("cp1251", "cp1251")])
def test_encodings(spark, tmp_path, encoding, name):
    file = tmp_path / "in.csv"
    file.write_bytes("Фраза;Частота\nкупить слона;10\nкак, где;x\n".encode(encoding))
    assert D.detect_encoding(D.head_of(spark, str(file))) == name
    got = D.phrases(D.read_delimited(spark, str(file))).orderBy("source_row").collect()
    assert [(r["phrase"], r["search_volume"]) for r in got] == [("купить слона", 10.0), ("как, где", 0.0)]


def test_cut_character_and_separators():
    assert D.detect_encoding("абв".encode()[:-1]) == "utf-8"
    assert [D.detect_separator(h) for h in ("a;b", "a,b", "a\tb", "keyword", "x")] == [";", ",", "\t", "\t", "\t"]
    assert D.phrase_column(["N", "Запрос"]) == "Запрос" and D.volume_column(["Частотность"]) == "Частотность" and D.volume_column(["x"]) is None
    with pytest.raises(ValueError):
        D.phrase_column(["a"], "b")


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    rows = [("a <b> & c", 1.5, None), ("é", 2, "x"), ("  s ", 3, "y")]
    assert write_workbook(path, {"One": (["p", "v", "n"], rows), "Two": (["k"], [])}, most=2) == {"One": 2, "One 2": 1, "Two": 0}
    assert [tuple(r) for r in read_workbook(spark, path, "One").collect()] == [("a <b> & c", "1.5", None, 1), ("é", "2", "x", 2)]
    assert read_workbook(spark, path, "One 2").first()["p"] == "  s " and read_workbook(spark, path, "Two").count() == 0


def test_reservoir_knows_the_first_row_of_a_phrase_it_let_go(spark, tmp_path):
    # "late" loses its place in the first file and comes back with the volume of "other", whose first row is later than its own.
    for rows in ([("late", 1.0, 1), ("big", 8.0, 2), ("large", 7.0, 3)], [("other", 9.0, 5), ("late", 9.0, 6)], [("late", 2.0, 7)]):
        spark.createDataFrame(rows, "phrase string, search_volume double, source_row bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    write_reservoir(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 0, 1).awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    states = spark.read.parquet(str(tmp_path / "out"))
    last = states.where(F.col("state") == states.agg(F.max("state")).first()[0])
    assert [(r["normalized"], r["search_volume"], r["source_row"]) for r in last.collect()] == [("late", 9.0, 1)]


def test_parts_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"p {k % 3}", 1.0, k) for k in range(9)], "phrase string, search_volume double, source_row bigint")
    rows.repartition(3, "source_row").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        write_parts(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("part", "normalized").count().where("count > 1").count() == 0 and got.select("normalized").distinct().count() == 3


def test_files(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a.txt"
    files.create_text(path, "é")
    with pytest.raises(FileExistsError):
        files.create_text(path, "x")
    files.replace_text(path, "new")
    assert files.read_text(path) == "new" and files.resolve_input(path) == path
    files.make_folder(f"{tmp_path}/in")
    files.copy(path, f"{tmp_path}/in/b.txt")
    assert files.names(f"{tmp_path}/in") == ["b.txt"] and files.resolve_input("b.txt", f"{tmp_path}/in").endswith("in/b.txt")
    files.move(f"{tmp_path}/in", f"{tmp_path}/out")
    assert not files.exists(f"{tmp_path}/in") and files.exists(f"{tmp_path}/out/b.txt")
    with pytest.raises(FileNotFoundError):
        files.resolve_input("none.csv", f"{tmp_path}/out")


def test_sheet_with_the_phrase_column(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    write_workbook(path, {"Notes": (["a"], [("x",)]), "Data": (["N", "Запрос"], [(1, "купить")]), "More": (["own"], [("y",)])})
    assert find_sheet(spark, path) == "Data" and find_sheet(spark, path, "OWN") == "More"
    with pytest.raises(ValueError, match="Notes"):
        find_sheet(spark, path, "absent")


def test_progress_events(spark, tmp_path):
    import time

    events = []
    listener = Progress(events.append)
    spark.streams.addListener(listener)
    try:
        rows = spark.createDataFrame([(f"p {k}", 1.0, k) for k in range(4)], "phrase string, search_volume double, source_row bigint")
        rows.repartition(2, "source_row").write.parquet(str(tmp_path / "in"))
        write_parts(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        for _ in range(100):
            if any(e["event"] == "finished" for e in events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(e.get("rows", 0) for e in events if e["event"] == "part") == 4 and events[0]["event"] == "started" and events[-1]["event"] == "finished"


def test_job_state(spark, tmp_path):
    job = Job.create(tmp_path, "j", {"topic": {}, "intent": {"default": "commercial"}, "clustering": {"a": [1, 2]}})
    job.update("run", x=1)
    assert job.update(y=2)["x"] == 1 and job.state()["stage"] == "run"
    token = job.acquire()
    with pytest.raises(RuntimeError):
        job.acquire()
    job.release("other")
    assert job.lock_owner()
    job.release(token)
    assert job.lock_owner() is None
    job.write_json(job.LOCK, {"pid": 2**22 + 1, "token": "x"})
    job.release(job.acquire())
    job.write_json(job.LOCK, {"pid": 2**22 + 1, "token": "x", "host": "another machine"})
    assert job.lock_owner()
    job.release("x")
    job.write_json(job.LOCK, {"pid": 1, "token": "y"})
    assert job.lock_owner()
    job.release("y")
    assert check_config(job.config()) == [] and len(check_config({})) == 3 and ("clustering.a", "1 | 2") in flatten(job.config())
    assert next_version(job.folder, "r") == job.path("r_run_001")
    files.make_folder(job.path("r_run_009"))
    assert next_version(job.folder, "r") == job.path("r_run_010") and latest_version(job.folder, "r") == job.path("r_run_009")
    assert Job.find(tmp_path, job.config()["workflow_job_id"]).folder == job.folder
    with pytest.raises(ValueError):
        Job.find(tmp_path, "seo-" + "0" * 16)


def test_a_job(spark, tmp_path):
    """Six hundred phrases: prepared, labelled by rule, run, cluster decisions applied, finalized, learned."""
    def phrase(k):
        return (f"купить насос модель {k}", f"как работает насос номер {k}", f"смотреть фильм серия {k}")[k % 3]

    file = tmp_path / "core.tsv"
    file.write_text("keyword\tvolume\n" + "".join(f"{phrase(k)}\t{k}\n" for k in range(600)), encoding="utf-8")
    base = ["--root", str(tmp_path / "jobs"), "--knowledge", str(tmp_path / "known")]
    call = lambda *a: execute(parser().parse_args([*base, *a]), spark)
    assert call("prepare", str(file), "--job", "j", "--topic", "Насосы", "--sample-size", "200")["phrases"] == 600
    assert call("next", "--job", "j")["action"] == "sample"
    sheet = spark.read.parquet(str(tmp_path / "jobs/j/sheet")).collect()
    label = lambda p: "commercial" if p.startswith("купить") else "informational" if p.startswith("как") else "garbage"
    assert len(call("review", "--job", "j", "--limit", "7")) == 7
    file = tmp_path / "labels.json"
    file.write_text(json.dumps({"labels": [{"sample_id": r["sample_id"], "label": "garbage", "confidence": 0.5, "notes": "first"} for r in sheet[:5]] + [{"id": "row-x"}]}))
    assert call("apply-labels", "--job", "j", "--labels", str(file))["applied"] == 5
    done = call("apply-labels-inline", "--job", "j", "--labels", ";".join(f"{r['sample_id']}|{label(r['phrase'])}|0.9" for r in sheet) + ";row-x|oops|1")
    assert done["reviewed"] == len(sheet)
    result = call("run-auto", "--job", "j")
    assert sum(result["rows"].values()) == 600 and all(result["rows"][x] > 150 for x in ("commercial", "informational", "garbage"))
    assert read_workbook(spark, result["output"] + ".xlsx", "Human review").count() > 0
    manifest = json.loads((tmp_path / "jobs/j/manifest.json").read_text())
    assert manifest["intent_counts"] == result["rows"] and json.loads((tmp_path / "jobs/j/inspection.json").read_text())["phrases"] == 600
    table = next((tmp_path / "jobs/j" / (result["output"].rpartition("/")[2] + "_tables/cluster_summary.csv")).glob("part-*")).read_bytes()
    assert table.startswith(b"\xef\xbb\xbfintent,cluster,") and table.count(b"\xef\xbb\xbf") == 1
    assert call("provenance", result["output"] + ".xlsx")["Job"] == "j"
    clusters = call("cluster-review", "--job", "j", "--limit", "30")
    call("apply-cluster-labels-inline", "--job", "j", "--labels", f"{clusters[0]['id']}|garbage")
    final = call("apply-cluster-decisions", "--job", "j")
    assert final["rows"]["garbage"] > result["rows"]["garbage"]
    assert call("finalize", "--job", "j")["final"].endswith("_FINAL") and call("next", "--job", "j")["status"] == "stop"
    assert call("learn", "--job", "j")["examples"] == len(sheet)
    known = call("knowledge")
    assert sum(r["n"] for r in known) == len(sheet)
    call("forget", "--topic", known[0]["topic_key"], "--confirm", known[0]["topic_key"])
    assert call("knowledge") == []
    assert spark.read.parquet(str(tmp_path / "jobs/j/final")).where(F.col("final_basis") == "Cluster audit").count() > 0


def _small_job(spark, tmp_path, name, config, labels=()):
    job = Job.create(tmp_path, name, {"topic": {"key": "t", **config.get("topic", {})}, "intent": {"default": "commercial", **config.get("intent", {})}, "clustering": {}} | {k: v for k, v in config.items() if k not in ("topic", "intent")})
    file = tmp_path / f"{name}.csv"
    texts = [f"насос {w} модель {k}" for k in range(40) for w in ("заказать", "устройство", "цена")]
    file.write_text("keyword\n" + "\n".join(texts), encoding="utf-8")
    w = Workflow(spark, job)
    w.prepare(str(file))
    if labels:
        sheet = w.table("sheet").collect()
        w.apply_labels(";".join(f"{r['sample_id']}|{labels[k % len(labels)]}|0.9" for k, r in enumerate(sorted(sheet, key=lambda r: r["source_row"])) if "модель 1" in r["phrase"]))
    return w


def test_prototypes_change_decisions(spark, tmp_path):
    """The same labels, which say little, with and without prototypes."""
    policy = {"commercial_prototypes": ["насос цена модель", "цена насоса", "узнать цена насос"], "implicit_commercial_prototypes": [f"насос цена модель {k}" for k in range(5)], "informational_prototypes": [f"насос устройство модель {k}" for k in range(8)]}
    shares = []
    for name, config in (("without", {}), ("with", {"intent_policy": policy})):
        w = _small_job(spark, tmp_path, name, config, ("commercial", "informational"))
        labels = L.last_wins(w.table("sheet"))
        decided = w._decided_by_models(w.job.config(), labels)
        rows = decided.where("not exact_label").collect()
        right = [r["intent"] == ("informational" if "устройство" in r["phrase"] else "commercial") for r in rows]
        shares.append(sum(right) / len(right))
        assert (sum(abs(r["policy_adjustment"]) > 0 for r in rows) > 0) == (name == "with")
    assert shares[1] > max(0.9, shares[0])


def test_seeds_decide_without_labels(spark, tmp_path):
    seeds = {"topic": {"relevant_seeds": ["насос модель"], "garbage_seeds": ["смотреть фильм"]}, "intent": {"commercial_seeds": ["заказать насос", "насос цена"], "informational_seeds": ["насос устройство"]}}
    w = _small_job(spark, tmp_path, "seeds", seeds)
    with pytest.raises(ValueError):
        _small_job(spark, tmp_path, "none", {}).run()
    result = w.run()
    assert sum(result["rows"].values()) == 120 and result["rows"]["informational"] >= 30 and result["rows"]["commercial"] >= 60
    assert {r["decision_basis"] for r in w.result().select("decision_basis").distinct().collect()} <= {"Commercial seed similarity", "Informational seed similarity", "Ambiguous seed result", "Seed-based topic relevance"}


def test_policy_needs_enough_and_keeps_lists_apart(spark):
    rows = spark.createDataFrame([("купить насос", "commercial", 1)], "phrase string, label string, source_row int")
    lists = {k: [f"{k} {i}" for i in range(n)] for k, n in L.LEAST_POLICY.items()}
    assert L.apply_policy(rows, lists)["accepted"]
    for k, n in L.LEAST_POLICY.items():
        with pytest.raises(ValueError, match=k):
            L.apply_policy(rows, lists | {k: lists[k][: n - 1] + [lists[k][0].upper()]})
    with pytest.raises(ValueError, match="both"):
        L.apply_policy(rows, lists | {"commercial_signals": [*lists["commercial_signals"], "купить!"], "informational_signals": [*lists["informational_signals"], "Купить"]})
    with pytest.raises(ValueError, match="weak"):
        L.apply_policy(rows, lists | {"weak_question_signals": [*lists["commercial_signals"][:3]]})


def test_learning_many_times_keeps_numbers_small(spark, tmp_path):
    w = _small_job(spark, tmp_path, "learn", {}, ("commercial", "informational"))
    w.knowledge = str(tmp_path / "known")
    w.save(spark.createDataFrame([("насос цена модель 1", "garbage", 3)], "phrase string, label string, source_row bigint"), "corrections")
    for _ in range(10):
        w.learn()
    known = {r["phrase"]: r for r in spark.read.parquet(w.knowledge).collect()}
    assert known["насос цена модель 1"]["label"] == "garbage" and max(r["seq"] for r in known.values()) < 1 << 50
