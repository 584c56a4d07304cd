"""Each stage of the pipeline on its own input."""

import re

import corpus_pipeline
from phrasemill.llm import secrets_scan, simhash
from tests.llm.test_operators import shingles, union


def test_stages_keep_the_columns_and_do_their_work(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    assert {r["doc_id"] for r in seen["language"]} >= {r["doc_id"] for r in before if len(re.findall("[a-zA-Z]", r["text"])) > 100}
    norm = {}
    for r in sorted(seen["language"], key=lambda r: r["doc_id"]):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert sorted(norm.values()) == sorted(r["doc_id"] for r in seen["exact_copies"])
    sets = {r["doc_id"]: shingles(r["text"]) for r in seen["exact_copies"]}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    fps = {r["doc_id"] for r in seen["near_copies"]}
    find = union(pairs)
    assert fps == {d for d in sets if find(d) == d}
    assert {r["doc_id"] for r in seen["secrets"]} == set(fps)
    assert not any(secrets_scan.base_spans(r["text"]) for r in seen["secrets"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(fps)
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(packed)


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_copies_are_told_apart_by_row(spark):
    schema = "doc_id int, text string, lang string, source string, n_chars int"
    near = [f"w{i}" for i in range(200)]
    rows = [(3, "x y z"), (5, "x y z"), (5, "other text here"), (5, "other text here"), (None, "x y z"), (None, "x  y z"), (None, "no id here"), (None, "no  id here"), (7, None), (8, ""), (9, " \n"), (10, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema).repartition(3)
    got = corpus_pipeline.exact_copies(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted((str(r["doc_id"]), (r["text"] or "").split()) for r in got.collect()) == sorted([("3", ["x", "y", "z"]), ("5", ["other", "text", "here"]), ("None", ["no", "id", "here"]), ("7", []), ("9", [])])
    rows = [(4, " ".join(near)), (4, "quite another text"), (6, " ".join(near[:190])), (6, "one more text"), (None, " ".join(near[5:])), (None, "nothing like it"), (9, None), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema).repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("4", rows[0][1]), ("4", rows[1][1]), ("6", rows[3][1]), ("None", rows[5][1]), ("8", "")])
    for _, stage in (s for s in corpus_pipeline.STAGES if s[0] in ("secrets", "packing")):
        assert stage(spark, docs, "").select("doc_id").distinct().count() == 5


def test_near_copies_come_from_fingerprints_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:1500], "new", *words[1501:]]), "quite another text with words of its own", "", None]
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    assert [simhash.fingerprint_of(h) & (1 << 64) - 1 for h in sets] == [simhash.simhash(t, 5) for t in texts]
    prints = spark.createDataFrame([(k, simhash.fingerprint_of(h)) for k, h in enumerate(sets)], "s bigint, fp bigint")
    assert sorted(tuple(r) for r in simhash.fingerprint_pairs(prints, 4).collect()) == [(1, 0), (4, 3)]
    radii = []
    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda nodes, radius, pairs=False: radii.append(radius) or links(nodes, radius, pairs))
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id int, text string, lang string, source string, n_chars int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2, 3]
    assert radii == [4]
