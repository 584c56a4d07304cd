"""Command line: python -m phrasemill COMMAND --job NAME ...; answers are JSON, errors one line of JSON and exit status 1."""

from __future__ import annotations

import argparse
import json
import sys

#: A reviewed workbook names its job, so these need no --job.
OF_WORKBOOK = ("feedback", "apply-review", "provenance")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phrasemill")
    top.add_argument("--root", default="jobs", help="folder of the jobs")
    top.add_argument("--knowledge", default="knowledge/examples.parquet")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("--quiet", action="store_true")
        if name not in ("knowledge", "forget"):
            sub.add_argument("--job", required=name not in OF_WORKBOOK)
        for flag, more in options:
            sub.add_argument(flag, **more)

    limit = lambda n: ("--limit", {"type": int, "default": n})
    add("prepare", ("input", {}), ("--topic", {"required": True}), ("--sample-size", {"type": int, "default": 800}), ("--phrase-column", {}), ("--frequency-column", {}), ("--reuse-topic", {"default": "auto"}), ("--prior-limit", {"type": int, "default": 150}))
    add("status", ("--compact", {"action": "store_true"}))
    add("next")
    add("sample", ("--offset", {"type": int, "default": 0}), limit(25), ("--include-labeled", {"action": "store_true"}))
    for name in ("apply-labels", "apply-labels-inline", "apply-family-labels-inline", "apply-cluster-labels-inline"):
        add(name, ("--labels", {"required": True}))
    for name, n in (("family-review", 20), ("family-coverage-review", 50), ("review", 20), ("relevance-review", 50), ("intent-review", 50), ("policy-conflict-review", 50), ("cluster-review", 30), ("priority-review", 20), ("policy-context", 8)):
        add(name, limit(n))
    lists = ("commercial", "implicit-commercial", "informational", "commercial-signals", "informational-signals", "weak-question-signals", "relevant", "garbage")
    add("apply-policy-inline", *[(f"--{x}", {"required": True}) for x in lists])
    for name in ("run", "run-large", "run-auto", "export-large", "apply-cluster-decisions"):
        add(name, ("--output", {}))
    add("finalize", ("--source", {}))
    add("feedback", ("workbook", {}))
    add("apply-review", ("workbook", {}))
    add("provenance", ("workbook", {}))
    add("learn", ("--reviewed-workbook", {}))
    add("knowledge")
    add("cleanup")
    add("forget", ("--topic", {"required": True}), ("--confirm", {"required": True}))
    return top


PAGES = {"sample": "sample", "family-review": "families", "family-coverage-review": "coverage", "review": "active", "relevance-review": "relevance", "intent-review": "intent", "policy-conflict-review": "policy", "cluster-review": "clusters", "priority-review": "priority", "policy-context": "context"}


def _job_of(args: argparse.Namespace, spark):
    """The job whose id a reviewed workbook carries, exactly once."""
    from .plans.state import Job
    from .sources.workbooks import read_workbook

    ids = [r["Value"] for r in read_workbook(spark, args.workbook, "_Workflow").where("Parameter = 'Workflow Job ID'").collect()]
    if len(ids) != 1:
        raise ValueError(f"the workbook has {len(ids)} job ids")
    return Job.find(args.root, ids[0])


def execute(args: argparse.Namespace, spark) -> object:
    from .functions.text import marker_text
    from .plans.state import Job
    from .plans.workflow import Workflow
    from .sources.workbooks import read_workbook

    if args.command in ("knowledge", "forget"):
        w = Workflow(spark, Job(args.root), args.knowledge)
        return w.knowledge_summary() if args.command == "knowledge" else w.forget(args.topic, args.confirm)
    if args.command == "prepare":
        key = "-".join(marker_text(args.topic).replace("*", "").split())[:100] or "topic"
        config = {"topic": {"key": key, "description": args.topic}, "intent": {"default": "commercial"}, "clustering": {}}
        w = Workflow(spark, Job.create(args.root, args.job, config), None if args.reuse_topic == "none" else args.knowledge)
        return w.prepare(args.input, args.sample_size, args.phrase_column, args.frequency_column, args.prior_limit)
    job = Job(f"{args.root}/{args.job}") if args.job else _job_of(args, spark)
    w = Workflow(spark, job, args.knowledge)
    c = args.command
    if c in PAGES:
        return w.page(PAGES[c], args.limit, getattr(args, "offset", 0), getattr(args, "include_labeled", False))
    if c == "apply-policy-inline":
        names = {"commercial": "commercial_prototypes", "implicit_commercial": "implicit_commercial_prototypes", "informational": "informational_prototypes", "relevant": "relevant_prototypes", "garbage": "garbage_prototypes"}
        given = {k: [v.strip() for v in getattr(args, k).split(";") if v.strip()] for k in (*names, "commercial_signals", "informational_signals", "weak_question_signals")}
        return w.apply_policy({names.get(k, k): v for k, v in given.items()})
    if c in ("feedback", "apply-review", "learn"):
        book = getattr(args, "workbook", None) or getattr(args, "reviewed_workbook", None)
        done = w.feedback(book) if book else {}
        return done if c == "feedback" else done | w.learn()
    if c == "provenance":
        return {r["Parameter"]: r["Value"] for r in read_workbook(spark, args.workbook, "_Workflow").collect()}
    simple = {
        "status": lambda: w.job.state() if args.compact else w.status(),
        "next": w.next,
        "apply-labels": lambda: w.apply_label_file(args.labels),
        "apply-labels-inline": lambda: w.apply_labels(args.labels),
        "apply-family-labels-inline": lambda: w.apply_family_labels(args.labels),
        "apply-cluster-labels-inline": lambda: w.apply_cluster_labels(args.labels),
        "run": lambda: w.run(args.output),
        "run-large": lambda: w.run(args.output),
        "run-auto": lambda: w.run(args.output),
        "export-large": lambda: w.export(args.output),
        "apply-cluster-decisions": lambda: w.apply_cluster_decisions(args.output),
        "finalize": lambda: w.finalize(args.source),
        "cleanup": w.cleanup,
    }
    return simple[c]()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    try:
        answer = execute(args, SparkSession.builder.appName("phrasemill").getOrCreate())
    except (ValueError, OSError, RuntimeError) as error:
        print(json.dumps({"error": str(error)}, ensure_ascii=False), file=sys.stderr)
        return 1
    print(json.dumps(answer, ensure_ascii=False, indent=None if args.quiet else 2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
