"""The steps of a job over DataFrames: prepare, label, audit, run, export, learn."""

from __future__ import annotations

import json
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import inline_fields, label_of, normalize
from ..operators import clusters as C
from ..operators import families as M
from ..operators import features as X
from ..operators import labels as L
from ..operators import models as Y
from ..operators import phrases as P
from ..operators import review as R
from ..operators.decide import basis, decide, override_with_labels, seed_decision
from ..sources import files
from ..sources.delimited import phrases, read_delimited
from ..sources.workbooks import SHEET_ROWS, find_sheet, read_workbook, result_sheets, write_workbook
from .next_action import Facts, next_action
from .state import Job, check_config, latest_version, next_version, now, settings_of

KNOWLEDGE = "topic_key string, phrase_key string, phrase string, label string, confidence double, verification string, source_job string, seq bigint"

#: Labels that a page's ranking needs, lists of prototypes and what they are examples of.
LEAST_FOR_PAGES = 20
RELEVANCE_LISTS = {"relevant_prototypes": "relevant", "garbage_prototypes": "garbage"}
INTENT_LISTS = {"commercial_prototypes": "commercial", "implicit_commercial_prototypes": "commercial", "informational_prototypes": "informational"}
#: Rows up to which a result also comes as a workbook.
WORKBOOK_ROWS = 2_000_000


class Workflow:
    """Commands of one job. Tables are Parquet in the job's folder; a step that changes one writes a new one and swaps it in."""

    def __init__(self, spark: SparkSession, job: Job, knowledge: str | None = None) -> None:
        self.spark, self.job, self.knowledge = spark, job, knowledge

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.job.path(name))

    def save(self, df: DataFrame, name: str) -> None:
        beside = self.job.path(f".{name}.new")
        df.write.mode("overwrite").parquet(beside)
        files.move(beside, self.job.path(name))

    # -- preparation ---------------------------------------------------------------------------------------------------

    def prepare(self, source: str, sample: int = 800, phrase: str | None = None, volume: str | None = None, prior: int = 150) -> dict:
        source = files.resolve_input(source)
        raw = read_workbook(self.spark, source, find_sheet(self.spark, source, phrase)) if source.lower().endswith(".xlsx") else read_delimited(self.spark, source)
        self.save(P.phrase_table(phrases(raw, phrase, volume)), "phrases")
        table = self.table("phrases")
        n = table.count()
        rows = table.agg(F.sum("occurrences")).first()[0] or 0
        self.save(M.select_families(M.family_counts(table), n), "selected")
        selected = self.table("selected")
        self.save(M.family_examples(table, selected), "pool")
        self.save(M.candidates(selected, M.diverse_examples(self.table("pool")), n), "candidates")
        coverage = M.coverage_rows(self.table("pool"), selected)
        chosen = (P.representative_sample(table, sample) if n > sample else table.withColumn("reason", F.lit("all"))).select("normalized")
        picked = coverage.join(chosen, "normalized", "full").withColumn("coverage_family", F.coalesce("coverage_family", F.lit("")))
        source_name = F.when(F.col("coverage_family") != "", "current family coverage sample").otherwise("current representative sample")
        sheet = picked.join(table, "normalized").select(
            F.format_string("row-%06d", "source_row").alias("sample_id"), "source_row", "phrase", "normalized", "occurrences", "search_volume", "coverage_family",
            F.lit("").alias("model_label"), F.lit(None).cast("double").alias("model_confidence"), F.lit("").alias("model_notes"), source_name.alias("knowledge_source"))
        topic = self.job.config()["topic"].get("key", "topic")
        if self.knowledge and files.exists(self.knowledge) and n > 500:
            known = L.balanced(self.spark.read.parquet(self.knowledge), topic, min(prior, max(1, sample // 3)))
            keys = known.select(F.col("phrase_key").alias("normalized"), F.col("label").alias("_l"), F.col("confidence").alias("_c"), F.col("verification").alias("_v"))
            sheet = sheet.join(keys, "normalized", "left").withColumns({"model_label": F.coalesce("_l", "model_label"), "model_confidence": F.coalesce("_c", "model_confidence"), "knowledge_source": F.coalesce("_v", "knowledge_source")}).drop("_l", "_c", "_v")
        self.save(sheet, "sheet")
        self.job.update("initial_labeling", source=source, source_rows=int(rows), unique_phrases=n)
        found = {"phrases": n, "families": selected.count(), "sample": self.table("sheet").count()}
        self.job.write_json("inspection.json", found | {"source": source, "columns": raw.columns, "source_rows": int(rows), "topic": topic})
        return found

    # -- status --------------------------------------------------------------------------------------------------------

    def facts(self) -> Facts:
        state, config = self.job.state(), self.job.config()
        if not self.job.has("sheet"):
            return Facts(stage=state.get("stage", "unknown"), inspected=False)
        sheet = self.table("sheet")
        m = L.quality(sheet, tuple(config["topic"].get("positive_markers", ()))).first().asDict()
        own = {r["label"]: r["n"] for r in L.current_counts(sheet).collect()}
        policy, relevance, intent = (config.get(k) or {} for k in ("intent_policy", "relevance", "intent"))
        sizes = {k: len(policy.get(k, ())) for k in ("commercial_prototypes", "implicit_commercial_prototypes", "informational_prototypes")}
        sizes |= {"relevant_prototypes": len(relevance.get("relevant_prototypes", ())), "garbage_prototypes": len(relevance.get("garbage_prototypes", ()))}
        sizes |= {k: len(intent.get(v, ())) for k, v in (("commercial_signals", "commercial_markers"), ("informational_signals", "informational_markers"), ("weak_question_signals", "weak_question_markers"))}
        families = self.table("candidates").count() - len(state.get("family_labels", {})) if self.job.has("candidates") else 0
        clusters = self.table("audit").select("id").distinct().count() - len(state.get("cluster_decisions", {})) if self.job.has("audit") else 0
        return Facts(
            stage=state.get("stage", "unknown"), running=self.job.lock_owner() is not None, reviewed=m["confidence_complete_rows"], total=m["sample_rows"],
            source_total=state.get("unique_phrases", m["sample_rows"]), garbage=m["garbage_rows"], own=own, config_errors=check_config(config), errors=L.messages(m)[0],
            priority=m["high_priority_unreviewed"], families=families, coverage=L.family_status(sheet).first()["remaining"], clusters=clusters, policy=sizes,
            refine=bool(state.get("refine")), attempts=state.get("attempts", 0), audits=state.get("audits", 0), yields=state.get("yields", []),
            intent_audits=state.get("intent_audits", 0), policy_audits=state.get("policy_audits", 0), checked_at=state.get("checked_at", 0))

    def status(self) -> dict:
        return self.job.state() | {"facts": vars(self.facts())}

    def next(self) -> dict:
        return next_action(self.facts())

    # -- labels ----------------------------------------------------------------------------------------------------------

    def apply_labels(self, inline: str) -> dict:
        """'id|label|confidence; ...' into the sheet; returns how many entries were valid."""
        rows = self.spark.range(1).select(F.explode(inline_fields(F.lit(inline), 3)).alias("e"))
        return self._apply_labels(rows.select(F.col("e")[0].alias("sample_id"), F.col("e")[1].alias("label"), F.col("e")[2].alias("confidence"), F.lit(None).cast("string").alias("notes")))

    def apply_label_file(self, path: str) -> dict:
        """Labels of a JSON file: a list, or an object with the list as labels or rows, of objects with sample_id or id, label, confidence, notes."""
        try:
            content = json.loads(files.read_text(path))
        except ValueError as error:
            raise ValueError(f"{path} holds no labels: {error}") from None
        entries = next((content[k] for k in ("labels", "rows") if k in content), None) if isinstance(content, dict) else content
        if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
            raise ValueError(f"{path} must hold a list of labels")
        text = lambda x: None if x is None else str(x)
        rows = [(text(e.get("sample_id", e.get("id"))), text(e.get("label")), text(e.get("confidence")), text(e.get("notes"))) for e in entries]
        return self._apply_labels(self.spark.createDataFrame(rows, "sample_id string, label string, confidence string, notes string"))

    def _apply_labels(self, given: DataFrame) -> dict:
        valid = given.withColumns({"label": label_of("label"), "confidence": F.col("confidence").try_cast("double")}).where("label is not null and confidence between 0 and 1")
        before = self.facts()
        updates = valid.groupBy("sample_id").agg(F.last("label").alias("label"), F.last("confidence").alias("confidence"), F.last("notes").alias("notes"))
        self.save(L.apply_labels(self.table("sheet"), updates), "sheet")
        after, state = self.facts(), self.job.state()
        audit = state.get("pending_audit")
        if audit:
            more = {"relevance": {"audits": state.get("audits", 0) + 1, "yields": [*state.get("yields", []), after.garbage - before.garbage]}, "intent": {"intent_audits": state.get("intent_audits", 0) + 1}, "policy": {"policy_audits": state.get("policy_audits", 0) + 1}}
            self.job.update(pending_audit=None, **more[audit])
        return {"applied": updates.count(), "reviewed": after.reviewed}

    def apply_family_labels(self, inline: str) -> dict:
        pairs = dict((p.split("|")[0].strip(), p.split("|")[1].strip()) for p in inline.split(";") if p.count("|") == 1)
        labels = self.job.state().get("family_labels", {}) | {k: v for k, v in pairs.items() if v in ("commercial", "informational", "neutral")}
        config = self.job.config()
        decisions = self.spark.createDataFrame(list(labels.items()) or [("", "")], "id string, label string")
        rules = L.family_rules(self.table("candidates"), decisions, tuple(config["intent"].get("weak_question_markers", ()))).collect()
        config["intent"]["family_rules"] = {x: sorted(r["pattern"] for r in rules if r["label"] == x) for x in ("commercial", "informational", "neutral")}
        self.job.save_config(config)
        self.job.update("intent_family_audit", family_labels=labels)
        return {"labeled": len(labels), "forced_neutral": sum(r["forced"] for r in rules)}

    def apply_policy(self, lists: dict[str, list[str]]) -> dict:
        rows = L.with_label(self.table("sheet")).where("label is not null and phrase <> ''")
        state, config = self.job.state(), self.job.config()
        found = L.apply_policy(rows, lists, state.get("coverage"))
        if found["accepted"]:
            names = {"commercial_signals": "commercial_markers", "informational_signals": "informational_markers", "weak_question_signals": "weak_question_markers"}
            config["intent"] |= {names[k]: v for k, v in found["lists"].items() if k in names} | {"rejected_strong_markers": found["rejected"]}
            config.setdefault("intent_policy", {}).update({k: lists[k] for k in ("commercial_prototypes", "implicit_commercial_prototypes", "informational_prototypes") if k in lists})
            config.setdefault("relevance", {}).update({k: lists[k] for k in ("relevant_prototypes", "garbage_prototypes") if k in lists})
            self.job.save_config(config)
            self.job.update("intent_policy", coverage=found["coverage"], refine=found["coverage"]["needs_refinement"])
        self.job.update(attempts=state.get("attempts", 0) + 1, checked_at=self.facts().reviewed)
        return found

    # -- pages of rows ---------------------------------------------------------------------------------------------------------

    def page(self, kind: str, limit: int, offset: int = 0, labeled: bool = False) -> list[dict]:
        """Rows of a review: sample, priority, coverage, families, active, relevance, intent, policy, context, clusters."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        if kind == "families":
            done = list(self.job.state().get("family_labels", {}))
            rows = self.table("candidates").where(~F.col("id").isin(done)).orderBy("id").limit(limit)
        elif kind == "clusters":
            done = list(self.job.state().get("cluster_decisions", {}))
            rows = self.table("audit").where(~F.col("id").isin(done)).orderBy("id").limit(5 * limit)
        else:
            sheet = self.table("sheet")
            simple = {"sample": lambda: L.sample_page(sheet, offset, limit, labeled), "priority": lambda: L.priority_review(sheet).limit(limit), "coverage": lambda: L.family_review(sheet, limit)}
            if kind in simple:
                rows = simple[kind]().select("sample_id", "phrase", "search_volume")
            elif kind == "context":
                rows = L.policy_context(L.with_label(sheet), tuple(self.job.config()["intent"].get("weak_question_markers", ())), min(12, max(3, limit)))
            else:
                rows = self._scored_page(kind, limit)
                self.job.update(pending_audit={"relevance": "relevance", "intent": "intent", "policy": "policy"}.get(kind))
        return [r.asDict(recursive=True) for r in rows.collect()]

    def _scored_page(self, kind: str, limit: int) -> DataFrame:
        rows = X.hashed_grams(L.with_label(self.table("sheet")), "normalized")
        labelled, open_rows = Y.with_weight(rows.where("label is not null")), rows.where("label is null")
        if not Y.enough_labels(Y.label_counts(labelled), LEAST_FOR_PAGES):
            # Too few labels to rank by: the rows of most volume come first.
            return L.sample_page(self.table("sheet"), 0, limit).select("sample_id", "phrase", "search_volume")
        relevance, intent = Y.fit_two_stage(labelled, least=LEAST_FOR_PAGES)
        scored = Y.probability(open_rows, intent, "c").withColumn("i", 1.0 - F.col("c"))
        scored = Y.probability(scored, relevance, "pg") if relevance else scored.withColumn("pg", F.lit(0.0))
        if kind == "intent":
            return R.intent_rank(scored, limit).select("sample_id", "phrase", "margin")
        if kind == "policy":
            settings = settings_of(self.job.config())
            judged = decide(scored.withColumns({"predicted": F.when(F.col("c") >= 0.5, "commercial").otherwise("informational"), "certainty": F.greatest("c", "i"), "margin": F.abs(F.col("c") - F.col("i")), "cluster": F.lit("")}), settings, prototypes=False)
            return R.policy_conflicts(judged, limit).select("sample_id", "phrase", "reason", "predicted")
        grams = lambda df: X.char_tfidf(df.select("sample_id", "normalized"), "sample_id", "normalized")
        both = grams(rows)
        mine = lambda df, name: both.join(df.select("sample_id"), "sample_id").withColumnRenamed("sample_id", name)
        if kind == "active":
            clash = X.neighbour_conflict(mine(open_rows, "key"), mine(labelled, "other"), labelled.select(F.col("sample_id").alias("other"), "label"))
            p = F.array("pg", (1.0 - F.col("pg")) * F.col("c"), (1.0 - F.col("pg")) * F.col("i"))
            ready = scored.withColumn("p", p).join(clash.withColumnRenamed("key", "sample_id"), "sample_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
            return R.active_rank(ready, limit).select("sample_id", "phrase", "conflict", "margin")
        far = X.novelty(mine(open_rows, "key"), mine(labelled.where("label <> 'garbage'"), "other")).withColumnRenamed("key", "sample_id")
        ready = R.relevance_score(scored.join(far, "sample_id"))
        chosen = R.farthest_first(ready.select("source_row", "pg", "novelty", "score", "vec"), limit)
        return chosen.join(ready.select("source_row", "sample_id", "phrase"), "source_row").orderBy("place").select("sample_id", "phrase", "reason")

    # -- run -------------------------------------------------------------------------------------------------------------------------

    def run(self, output: str | None = None) -> dict:
        """Fits, calibrates, decides, clusters and audits all phrases; one path for every size. Without enough labels, configured seeds decide."""
        if (errors := self.facts().errors) and not self._seeds():
            raise ValueError("the labels are not ready: " + "; ".join(errors[:5]))
        token = self.job.acquire()
        try:
            return self._run(output)
        except Exception as error:
            self.job.update("blocked", run_error=str(error)[:500])
            raise
        finally:
            self.job.release(token)

    def _run(self, output: str | None) -> dict:
        config, labels = self.job.config(), L.last_wins(self.table("sheet"))
        enough = Y.enough_labels(Y.label_counts(labels))
        decided = self._decided_by_models(config, labels) if enough else self._decided_by_seeds(config, labels)
        self.save(decided.withColumn("part", F.pmod(F.xxhash64("normalized"), F.lit(64))), "scored")
        decided, parts = self.table("scored"), []
        for label in ("commercial", "informational", "garbage"):
            rows = decided.where(F.col("intent") == label)
            sample = P.top(rows, 10_000, F.md5("normalized"))
            n = sample.count()
            names = Y.centroids(sample, C.cluster_count(n)) if n >= 8 else {}
            found = C.assign(rows, {f"{label[0]}{k}": v for k, v in names.items()}) if names else rows.withColumns({"cluster": F.lit("Small cluster"), "similarity": F.lit(1.0)})
            parts.append(found.withColumn("cluster_probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity"))).drop("vec", "similarity"))
        clustered = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("topic_relevance", 1.0 - F.col("p_garbage"))
        self.save(clustered, "clustered")
        names = C.names(self.table("clustered"), tuple(config.get("cluster_stop_words", ())))
        self.save(self.table("clustered").join(F.broadcast(names), ["intent", "cluster"], "left"), "decided")
        decided = self.table("decided")
        self.save(C.audit(decided), "audit")
        self.save(C.family_audit(decided, settings_of(config)), "family_audit") if settings_of(config).family_rules() else None
        self.job.save_config(config)
        self.job.update("cluster_relevance_review", cluster_decisions={})
        return self.export(output)

    def _decided_by_models(self, config: dict, labels: DataFrame) -> DataFrame:
        """All phrases decided by models of the labels and the prototypes; the garbage threshold that was found goes into config."""
        relevance_policy, intent_policy = (config.get(k) or {} for k in ("relevance", "intent_policy"))
        lists = {k: [v for v in (relevance_policy if k in RELEVANCE_LISTS else intent_policy).get(k, ()) if v.strip()] for k in (*RELEVANCE_LISTS, *INTENT_LISTS)}
        weight = {"relevance": float(relevance_policy.get("synthetic_weight", 1.0)), "intent": float(intent_policy.get("synthetic_weight", 0.75))}
        examples = [(v, label, stage, weight[stage]) for stage, names in (("relevance", RELEVANCE_LISTS), ("intent", INTENT_LISTS)) for k, label in names.items() for v in lists[k]]
        prototypes = self.spark.createDataFrame(examples, "phrase string, label string, stage string, weight double").withColumn("normalized", normalize("phrase")).where("normalized <> ''")
        structure = X.structural(labels.select("normalized").unionByName(prototypes.select("normalized")), "normalized")
        weights = {"relevance_features": float(relevance_policy.get("tfidf_weight", X.RELEVANCE_WEIGHT)), "intent_features": float(intent_policy.get("tfidf_weight", X.INTENT_WEIGHT))}
        features = lambda df: X.with_structure(X.hashed_grams(df, "normalized"), structure, "normalized", weights)
        training = features(Y.with_weight(labels)).persist()
        try:
            relevance, intent = Y.fit_two_stage(training, *weights, features(prototypes) if examples else None)
            if relevance:
                limits = Y.calibrate(Y.out_of_fold(training, "normalized", vec="relevance_features")).first()
                config.setdefault("relevance", {})["garbage_threshold"] = limits["garbage_threshold"]
        finally:
            training.unpersist()
        scored = Y.probability(features(self.table("phrases")), intent, "c", "intent_features").withColumn("i", 1.0 - F.col("c"))
        scored = Y.probability(scored, relevance, "pg", "relevance_features") if relevance else scored.withColumn("pg", F.lit(0.0))
        sides = {"cs": lists["commercial_prototypes"] + lists["implicit_commercial_prototypes"], "is_": lists["informational_prototypes"]}
        both = all(sides.values())
        if both:
            scored = scored.withColumns({name: C.best_similarity("vec", self._vectors(texts)) for name, texts in sides.items()})
        return basis(override_with_labels(decide(scored.drop(*weights), settings_of(config), prototypes=both), labels))

    def _vectors(self, texts: list[str]) -> np.ndarray:
        """Vectors of a short configured list."""
        rows = self.spark.createDataFrame([(t,) for t in texts], "phrase string").select(normalize("phrase").alias("normalized")).collect()
        return X.HashedGrams().encode([r["normalized"] for r in rows])

    def _seeds(self) -> dict[str, list[str]]:
        """Seeds of both intents and of the topic; nothing where an intent or the topic has none."""
        config = self.job.config()
        topic, intent = config.get("topic") or {}, config.get("intent") or {}
        seeds = {"relevant": topic.get("relevant_seeds"), "garbage": topic.get("garbage_seeds"), "commercial": intent.get("commercial_seeds"), "informational": intent.get("informational_seeds")}
        seeds = {k: [v for v in x or () if v.strip()] for k, x in seeds.items()}
        return seeds if all(seeds[k] for k in ("relevant", "commercial", "informational")) else {}

    def _decided_by_seeds(self, config: dict, labels: DataFrame) -> DataFrame:
        """All phrases decided by their similarity to seeds. The intent that was chosen has the confidence as its probability, the others share the rest."""
        topic, settings = config.get("topic") or {}, settings_of(config)
        vectors = X.hashed_grams(self.table("phrases"), "normalized")
        similar = vectors.withColumns({name: C.best_similarity("vec", self._vectors(texts) if texts else []) for name, texts in self._seeds().items()})
        chosen = seed_decision(similar, settings, tuple(topic.get("positive_markers", ())), tuple(topic.get("garbage_markers", ())))
        chosen = chosen.select(*vectors.columns, *(F.col(x).alias(f"seed_{x}") for x in ("intent", "basis", "confidence")))
        p = lambda label: F.when(F.col("seed_intent") == label, F.col("seed_confidence")).otherwise((1.0 - F.col("seed_confidence")) / 2)
        # The evidence flags are those of any decision; what it would decide by scores gives way.
        flagged = decide(chosen.withColumns({"pg": F.lit(0.0), "c": F.lit(0.5), "i": F.lit(0.5)}), settings, prototypes=False)
        taken = {"intent": F.col("seed_intent"), "pre_family_intent": F.col("seed_intent"), "confidence": F.col("seed_confidence"), "quarantined": (F.col("seed_intent") != "garbage") & (F.col("seed_confidence") < 0.55), "family_override": F.lit(False), "family_conflict": F.lit(False)}
        decided = override_with_labels(flagged.withColumns(taken | {f"p_{x}": p(x) for x in ("commercial", "informational", "garbage")}), labels)
        why: Column = F.when(F.col("exact_label"), "Reviewed label").otherwise(F.col("seed_basis"))
        return decided.withColumn("decision_basis", why).drop("seed_intent", "seed_basis", "seed_confidence")

    def apply_cluster_labels(self, inline: str) -> dict:
        pairs = dict((p.split("|")[0].strip(), p.split("|")[1].strip()) for p in inline.split(";") if p.count("|") == 1)
        known = self.job.state().get("cluster_decisions", {}) | {k: v for k, v in pairs.items() if v in ("relevant", "garbage", "mixed")}
        self.job.update(cluster_decisions=known)
        return {"decided": len(known)}

    def apply_cluster_decisions(self, output: str | None = None) -> dict:
        """Applies the cluster decisions to the run's rows, always from the intents of the run itself."""
        chosen = self.job.state().get("cluster_decisions", {})
        pairs = self.spark.createDataFrame([(k.split("-")[0], v) for k, v in chosen.items()] or [("", "relevant")], "id string, decision string")
        ids = self.table("audit").select("id", "intent", "cluster").distinct()
        decisions = ids.join(F.broadcast(pairs), "id").select("intent", "cluster", "decision")
        labels = self.spark.createDataFrame([(k, v) for k, v in chosen.items() if "-" in k] or [("", "relevant")], "review_id string, outlier_label string")
        exact = self.table("audit").join(F.broadcast(labels), "review_id").select(normalize("phrase").alias("normalized"), "outlier_label").dropDuplicates(["normalized"])
        decided = self.table("decided")
        near = C.outlier_candidates(decided, decisions, C.outlier_thresholds(decided), exact)
        learned = self._outliers(near, Y.outlier_training_set(self.table("audit"), decisions, self.table("audit").join(F.broadcast(labels), "review_id")))
        final = C.apply_decisions(decided, decisions, exact, learned)
        self.save(final, "final")
        self.save(R.post_audit(R.mixed_review(decided, decisions), R.human_review(decided, settings_of(self.job.config()).garbage_threshold).join(decided.select("normalized", "cluster"), "normalized"), decisions, final.where("final_basis like 'Outlier%'").select("normalized").distinct()), "post_review")
        self.job.update("quality_review")
        return self.export(output)

    def _outliers(self, candidates: DataFrame, training: DataFrame) -> DataFrame:
        """source_row of candidates that the outlier model calls garbage; none without enough examples or a safe threshold."""
        n = {r["outlier_label"]: r["count"] for r in training.groupBy("outlier_label").count().collect()}
        if n.get("relevant", 0) < 20 or n.get("garbage", 0) < 8:
            return candidates.select("source_row").limit(0)
        rows = X.hashed_grams(training.select(normalize("phrase").alias("normalized"), F.col("outlier_label").alias("label"), F.lit(1.0).alias("weight")), "normalized").persist()
        parts = []
        for k in range(5):
            fold = F.pmod(F.xxhash64("normalized"), F.lit(5)) == k
            parts.append(Y.probability(rows.where(fold), Y.fit_binary(rows.where(~fold), "label", "garbage"), "pg").select("label", "pg"))
        every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
        grid = [0.6 + k * (0.98 - 0.6) / 36 for k in range(37)]
        limit = Y.calibrate(every, grid, 0.90, 0.02, None, 3).first()["garbage_threshold"]
        if limit is None:
            return candidates.select("source_row").limit(0)
        scored = Y.probability(X.hashed_grams(candidates, "normalized"), Y.fit_binary(rows, "label", "garbage"), "outlier_probability")
        return scored.where(F.col("outlier_probability") >= limit).select("source_row")

    # -- results -------------------------------------------------------------------------------------------------------------------

    def result(self) -> DataFrame:
        if not self.job.has("final"):
            return self.table("decided")
        return self.table("final").withColumns({"intent": F.col("final_intent")})

    def export(self, output: str | None = None, workbook: bool = True) -> dict:
        """Parquet by intent, files of a sheet's size at most, small CSV tables, a manifest, and a workbook for people; returns rows by intent.

        The driver writes the workbook row by row, so that there is one for WORKBOOK_ROWS at most; beyond that the Parquet files are the result,
        and the manifest says so.
        """
        rows, config = self.result(), self.job.config()
        settings = settings_of(config)
        target = str(output) if output else next_version(self.job.folder, "result")
        rows.write.mode("overwrite").option("maxRecordsPerFile", SHEET_ROWS).partitionBy("intent").parquet(target)
        counts = {r["intent"]: r["n"] for r in rows.groupBy("intent").agg(F.count("*").alias("n")).collect()}
        review, summary = R.human_review(self.table("decided"), settings.garbage_threshold), C.summary(rows)
        tables = {"uncertain_review": review, "cluster_summary": summary} | ({"intent_family_audit": self.table("family_audit")} if self.job.has("family_audit") else {})
        for name, table in tables.items():
            self._csv(table, f"{target}_tables/{name}.csv")
        book = f"{target}.xlsx" if workbook and sum(counts.values()) <= WORKBOOK_ROWS else None
        if book:
            metadata = [("Workflow Job ID", config.get("workflow_job_id", "")), ("Job", self.job.name), ("Topic", str(config.get("topic", {}).get("description", ""))), ("Input file", str(self.job.state().get("source", ""))), ("Processing mode", "spark")]
            with tempfile.TemporaryDirectory() as own:
                # A workbook is written by the driver alone, and copied to where the result is.
                write_workbook(f"{own}/book.xlsx", result_sheets(rows, review, summary, metadata))
                files.copy(f"file://{own}/book.xlsx", book)
        manifest = {"status": "completed", "workflow_job_id": config.get("workflow_job_id"), "input": self.job.state().get("source"), "source_rows": self.job.state().get("source_rows"), "output": target, "workbook": book, "tables": {n: f"{target}_tables/{n}.csv" for n in tables}, "intent_counts": counts, "garbage_threshold": settings.garbage_threshold, "quarantine_threshold": settings.quarantine_threshold, "cluster_decisions": len(self.job.state().get("cluster_decisions", {})), "written_at": now()}
        self.job.write_json("manifest.json", manifest)
        self.job.update(last_run=target)
        return {"output": target, "rows": counts, "workbook": book}

    def _csv(self, df: DataFrame, path: str) -> None:
        """One CSV file of a table of bounded size, in a folder; it begins with the mark by which spreadsheets know UTF-8."""
        plain = df.select([F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields])
        marked = plain.withColumnRenamed(plain.columns[0], "\ufeff" + plain.columns[0])
        marked.coalesce(1).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)

    def finalize(self, source: str | None = None) -> dict:
        """Copies the last run, whose tables must exist, to <job>_FINAL."""
        last = str(source).removesuffix(".xlsx") if source else latest_version(self.job.folder, "result")
        if not last or not files.exists(last):
            raise FileNotFoundError("there is no run to finalize")
        if missing := [x for x in ("intent=commercial", "intent=informational") if x not in files.names(last)]:
            raise ValueError(f"the run lacks {missing}")
        target = self.job.path(f"{self.job.name}_FINAL")
        beside = self.job.path(f".{self.job.name}_FINAL.new")
        files.delete(beside)
        files.copy(last, beside)
        files.move(beside, target)
        self.job.update("finalized", final=target)
        return {"final": target}

    # -- feedback and knowledge ------------------------------------------------------------------------------------------------------

    def feedback(self, workbook: str) -> dict:
        """Corrections of a reviewed workbook of this job into the label sheet."""
        metadata = {r["Parameter"]: r["Value"] for r in read_workbook(self.spark, workbook, "_Workflow").collect()}
        if metadata.get("Workflow Job ID") != self.job.config().get("workflow_job_id"):
            raise ValueError("the workbook belongs to another job")
        review = read_workbook(self.spark, workbook, "Human review").select("phrase", "correct_intent", "source_row")
        valid = review.withColumn("label", label_of("correct_intent")).where("label is not null")
        new = L.import_feedback(self.table("sheet"), review).where("turn = 1").select(normalize("phrase").alias("normalized"), F.col("model_label").alias("_l"))
        sheet = self.table("sheet").join(new.dropDuplicates(["normalized"]), "normalized", "left")
        self.save(sheet.withColumns({"model_label": F.coalesce("_l", "model_label"), "model_confidence": F.when(F.col("_l").isNotNull(), 1.0).otherwise(F.col("model_confidence"))}).drop("_l"), "sheet")
        self.save(valid.select("phrase", "label", "source_row"), "corrections")
        return {"corrections": valid.count()}

    def learn(self) -> dict:
        """Labels and corrections into the knowledge store."""
        topic = self.job.config()["topic"].get("key", "topic")
        old = self.spark.read.parquet(self.knowledge) if self.knowledge and files.exists(self.knowledge) else self.spark.createDataFrame([], KNOWLEDGE)
        seq = old.agg(F.max("seq")).first()[0] or 0
        rows = L.last_wins(self.table("sheet")).select("normalized", "phrase", "label", F.lit(0.8).alias("confidence"), F.lit("model_reviewed").alias("verification"), "source_row")
        if self.job.has("corrections"):
            # Corrections come after the sheet, in their own order.
            after = (rows.agg(F.max("source_row")).first()[0] or 0) + 1
            rows = rows.unionByName(self.table("corrections").select(normalize("phrase").alias("normalized"), "phrase", "label", F.lit(1.0).alias("confidence"), F.lit("review_corrected").alias("verification"), (F.col("source_row") + after).alias("source_row")))
        new = rows.select(F.lit(topic).alias("topic_key"), F.col("normalized").alias("phrase_key"), "phrase", "label", "confidence", "verification", F.lit(self.job.name).alias("source_job"), (F.col("source_row") + seq + 1).alias("seq"))
        self._swap_knowledge(L.upsert(old, new))
        self.job.update("knowledge_saved", knowledge_topic_key=topic)
        return {"examples": self.spark.read.parquet(self.knowledge).count()}

    def forget(self, topic: str, confirm: str) -> dict:
        if confirm != topic:
            raise ValueError("confirm must repeat the topic")
        self._swap_knowledge(L.forget(self.spark.read.parquet(self.knowledge), topic))
        return {"forgotten": topic}

    def _swap_knowledge(self, df: DataFrame) -> None:
        beside = f"{self.knowledge}.new"
        df.write.mode("overwrite").parquet(beside)
        files.move(beside, self.knowledge)

    def knowledge_summary(self) -> list[dict]:
        return [r.asDict() for r in L.knowledge_status(self.spark.read.parquet(self.knowledge)).orderBy("topic_key", "label", "verification").collect()]

    def cleanup(self) -> dict:
        """Removes tables that can be made again."""
        gone = [n for n in ("scored", "clustered", "pool") if self.job.has(n)]
        for n in gone:
            files.delete(self.job.path(n))
        return {"removed": gone}

