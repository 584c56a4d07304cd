"""Queries that SQL cannot express, against plain versions of their definitions on the small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.catalog import family_queries, load, model_queries
from phrasemill.functions.families import DISCOVERY, DOCUMENTS
from phrasemill.functions.text import hash32
from phrasemill.operators import clusters as C
from phrasemill.operators import features as X
from phrasemill.operators import models as M
from phrasemill.operators import phrases as P
from phrasemill.operators import review as R

QUERIES = load()[0]


@pytest.fixture(scope="module")
def pool(spark, sf):
    """{family: phrases in order of place}"""
    out = {}
    for r in sorted(QUERIES["family_examples"](spark, sf).collect(), key=lambda r: (r["family"], r["place"])):
        out.setdefault(r["family"], []).append(r["normalized"])
    return out


def likeness(a, b):
    return len(a & b) / len(a | b)


def spread_out(phrases, family):
    """Eight phrases, each the first among those whose greatest likeness to the chosen ones is least."""
    heads = tuple(t.rstrip("*") for t in family.split())
    contexts = []
    for p in phrases:
        tokens = p.split()
        contexts.append({t for t in tokens if not t.startswith(heads)} | {f"__length_{min(len(tokens) // 3, 3)}"})
    taken = []
    while len(taken) < min(8, len(phrases)):
        left = [i for i in range(len(phrases)) if i not in taken]
        worst = {i: max([likeness(contexts[i], contexts[j]) for j in taken], default=0.0) for i in left}
        taken.append(min(left, key=worst.get))
    return [phrases[i] for i in taken]


def test_family_diverse_examples(spark, sf, pool):
    got = {r["family"]: r["examples"] for r in QUERIES["family_diverse_examples"](spark, sf).collect()}
    assert got == {family: spread_out(phrases, family) for family, phrases in pool.items()}


def test_family_candidates(spark, sf, pool):
    selected = {r["family"]: r for r in QUERIES["family_selection"](spark, sf).collect()}
    rows = family_queries._base(spark, sf).count()
    got = {r["pattern"]: r for r in QUERIES["family_candidates"](spark, sf).collect()}
    assert set(got) == set(selected) and len({r["id"] for r in got.values()}) == len(got)
    for family, r in got.items():
        assert r["kind"] == ("structural" if " " in family else "lexical") and r["occurrences"] == selected[family]["occurrences"]
        assert r["share"] == pytest.approx(r["occurrences"] / rows, abs=6e-7) and r["examples"] == spread_out(pool[family], family)


def test_family_coverage_rows(spark, sf, pool):
    places = {r["family"]: r["place"] for r in family_queries._selected(spark, sf)[1].collect()}

    def rank(family):
        return 0 if set(family.split()) & set(DOCUMENTS) else 1 if family in DISCOVERY else 2

    taken = {}
    for family in sorted(places, key=lambda f: (rank(f), places[f])):
        fresh = [p for p in pool[family][:8] if p not in taken][: (4, 2, 1)[rank(family)]]
        for p in fresh[: 50 - len(taken)]:
            taken[p] = family
    assert taken and {r["normalized"]: r["coverage_family"] for r in QUERIES["family_coverage_rows"](spark, sf).collect()} == taken


def test_representative_sample(spark, sf):
    from phrasemill.catalog.inputs import phrases_doc

    table = P.phrase_table(phrases_doc(spark, sf).withColumn("search_volume", F.lit(1.0))).collect()
    got = QUERIES["representative_sample"](spark, sf).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["reason"], set()).add(r["normalized"])
    assert len(got) == len({r["normalized"] for r in got}) == 800
    assert parts["priority"] == {r["normalized"] for r in sorted(table, key=lambda r: (-r["priority"], r["source_row"]))[:160]}
    assert parts["length"] == {r["normalized"] for r in sorted(table, key=lambda r: (-r["length"], r["source_row"]))[:80]} - parts["priority"]
    left = {r["normalized"] for r in table} - parts["priority"] - parts["length"] - parts["typical"]
    drawn = sorted(left, key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))
    assert parts["random"] == set(drawn[: len(parts["random"])])
    assert 0 < len(parts["typical"]) <= 364


def test_medoids_come_from_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(3) * 9, 200, axis=0) + rng.normal(0, 0.5, (600, 3))
    rows = spark.createDataFrame([(i, f"p{i}", v.tolist()) for i, v in enumerate(x)], "source_row bigint, normalized string, vec array<double>").repartition(5)
    sample = rows.where(F.col("source_row") % 10 == 0)
    centres = np.array(list(M.centroids(sample, 3).values()))
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    own = far.argmin(axis=1)
    want = {min(np.flatnonzero(own == k), key=lambda i: far[i, k]) for k in range(3)}
    got = M.medoids(rows, 3, sample)
    assert got.columns == ["source_row", "normalized"] and {r["source_row"] for r in got.collect()} == want
    assert any(i % 10 for i in want)
    assert M.medoids(rows, 0, sample).count() == 0


def test_relevance_review(spark, sf):
    from phrasemill.catalog.inputs import scored

    limit = 50
    rows = R.relevance_score(scored(spark, sf).withColumnRenamed("cs", "novelty"))
    first = {}
    for r in sorted(rows.select("normalized", "source_row", "pg", "novelty", "score").collect(), key=lambda r: r["source_row"]):
        first.setdefault(r["normalized"], r)
    phrases = sorted(first.values(), key=lambda r: r["source_row"])
    by = lambda name: sorted(phrases, key=lambda r: (-r[name], r["source_row"]))
    reasons = {}
    if max(r["pg"] for r in phrases) > 0:
        reasons |= {r["source_row"]: "garbage_model_candidate" for r in by("pg")[: limit // 3]}
    for r in by("novelty")[: limit // 4]:
        reasons.setdefault(r["source_row"], "semantic_outlier_candidate")
    got = {r["source_row"]: r["reason"] for r in QUERIES["relevance_review"](spark, sf).collect()}
    assert {k: v for k, v in got.items() if v != "diverse_candidate"} == reasons
    assert len(got) == min(limit, len(phrases))

    # The greedy part chooses from a pool: 800 phrases by hash and the heads of both rankings.
    hashed = {r["source_row"] for r in sorted(phrases, key=lambda r: hashlib.md5(r["normalized"].encode()).hexdigest())[:800]}
    pool = hashed | {r["source_row"] for r in by("pg")[:16] + by("novelty")[:28]}
    phrases = [r for r in phrases if r["source_row"] in pool]
    x = X.HashedGrams().encode([r["normalized"] for r in phrases])
    at = {r["source_row"]: i for i, r in enumerate(phrases)}
    chosen = [at[k] for k in reasons]
    while len(chosen) < len(got):
        left = [i for i in range(len(phrases)) if i not in chosen]
        chosen.append(max(left, key=lambda i: (0.75 * (1 - float((x[chosen] @ x[i]).max())) + 0.25 * phrases[i]["score"], -i)))
    assert {phrases[i]["source_row"] for i in chosen} == set(got)


def test_assignment_to_fixed_centres(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    vectors = {r["vec_id"]: np.array(r["vec"], np.float64) for r in rows.collect()}
    rng = np.random.default_rng(5)
    centres = {f"k{i:03d}": rng.normal(size=len(next(iter(vectors.values())))).tolist() for i in range(7)}
    got = {r["vec_id"]: (r["cluster"], r["similarity"]) for r in C.assign(rows, centres).collect()}
    for key, v in vectors.items():
        products = {name: float(v @ np.array(c)) for name, c in centres.items()}
        best = max(products, key=products.get)
        assert got[key][0] == best and got[key][1] == pytest.approx(products[best])


def test_centroids_query_places_every_vector(spark, sf):
    got = {r["vec_id"]: r["cluster"] for r in QUERIES["cluster_centroids"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()
    assert set(got) == {r["vec_id"] for r in rows} and len(set(got.values())) > 1


@pytest.mark.parametrize("name,stage,column", [("fit_relevance", 0, "pg"), ("fit_intent", 1, "c")])
def test_probabilities_minimise_the_penalised_loss(spark, sf, name, stage, column):
    """The query's values are sigmoids of a linear form whose penalised weighted loss has no slope."""
    rows = model_queries._training(spark, sf).select("normalized", "label", "weight", "vec").collect()
    model = M.fit_two_stage(model_queries._training(spark, sf))[stage]
    beta, bias = model.coefficients.toArray(), model.intercept
    use = [r for r in rows if stage == 0 or r["label"] in ("commercial", "informational")]
    x, y = np.array([r["vec"] for r in use], np.float64), np.array([r["label"] == ("garbage", "commercial")[stage] for r in use], float)
    counts = {v: (y == v).sum() for v in (0.0, 1.0)}
    positive = min(8.0, counts[0.0] / counts[1.0]) if stage == 0 else len(y) / (2 * counts[1.0])
    negative = 1.0 if stage == 0 else len(y) / (2 * counts[0.0])
    weight = np.array([r["weight"] for r in use]) * np.where(y == 1, positive, negative)
    p = 1 / (1 + np.exp(-(x @ beta + bias)))
    slope = x.T @ (weight * (p - y)) + beta
    assert np.abs(slope).max() < 0.02 * weight.sum() ** 0.5 and abs((weight * (p - y)).sum()) < 0.02 * weight.sum() ** 0.5
    want = {r["normalized"]: 1 / (1 + np.exp(-(np.array(r["vec"], np.float64) @ beta + bias))) for r in rows}
    got = {r["normalized"]: r[column] for r in QUERIES[name](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_out_of_fold_rows_are_scored_by_models_of_other_folds(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{i}", ("garbage", "commercial", "informational")[i % 3], 1.0, (rng.normal(0, 1, 4) + (i % 3 == 0)).tolist()) for i in range(63)]
    df = spark.createDataFrame(rows, "normalized string, label string, weight double, vec array<double>").persist()
    got = {r["normalized"]: r["pg"] for r in M.out_of_fold(df, "normalized").collect()}
    order = {r["normalized"]: r["h"] for r in df.select("normalized", hash32("normalized").alias("h")).collect()}
    fold = {}
    for label in ("garbage", "commercial", "informational"):
        for place, key in enumerate(sorted((r[0] for r in rows if r[1] == label), key=lambda k: (order[k], k)), 1):
            fold[key] = place % 5
    assert set(got) == set(fold)
    for k in range(5):
        model = M.fit_relevance(df.where(~F.col("normalized").isin([x for x, f in fold.items() if f == k])))
        for key, _, _, vec in rows:
            if fold[key] == k:
                assert got[key] == pytest.approx(1 / (1 + np.exp(-(np.dot(vec, model.coefficients.toArray()) + model.intercept))), abs=1e-4)
    df.unpersist()


def test_folds_are_fitted_together(spark, monkeypatch):
    """No fit a fold; folds without garbage elsewhere have no model."""
    monkeypatch.setattr(M, "fit_binary", lambda *a, **k: pytest.fail("a fit of its own"))
    rng = np.random.default_rng(9)
    rows = [(f"p{i}", "garbage" if i % 3 == 0 else "commercial", 1.0, (rng.normal(0, 1, 3) + 9 * (i % 3 == 0)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "normalized string, label string, weight double, vec array<float>")
    got = {r["normalized"]: r["pg"] for r in M.out_of_fold(df, "normalized").collect()}
    assert len(got) == 60 and all((got[k] > 0.5) == (label == "garbage") for k, label, _, _ in rows)
    assert {r["pg"] for r in M.out_of_fold(df.where("label <> 'garbage'"), "normalized").collect()} == {0.0}
    assert M.out_of_fold(df.where("false"), "normalized").count() == 0
