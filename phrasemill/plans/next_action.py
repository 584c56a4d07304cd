"""The one permitted next step of a job, as an ordered table of rules over a few numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.labels import LEAST_POLICY

#: Fixed values of the protocol.
INITIAL, SMALL, PER_INTENT, STANDARD, DIRTY = 150, 500, 30, 300, 500
LEAST_AUDITS, MOST_AUDITS, INTENT_AUDITS, POLICY_AUDITS, ATTEMPTS = 3, 6, 2, 1, 2
BATCH = {"label": 50, "families": 20, "coverage": 50, "audit": 50, "clusters": 30}
MEDIUM = 5000


@dataclass
class Facts:
    """What the rules look at."""

    stage: str = "initial_labeling"
    running: bool = False
    inspected: bool = True
    reviewed: int = 0
    total: int = 0
    source_total: int = 0
    garbage: int = 0
    own: dict[str, int] = field(default_factory=dict)
    config_errors: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    priority: int = 0
    families: int = 0
    coverage: int = 0
    clusters: int = 0
    policy: dict[str, int] = field(default_factory=dict)
    refine: bool = False
    attempts: int = 0
    audits: int = 0
    yields: list[int] = field(default_factory=list)
    intent_audits: int = 0
    policy_audits: int = 0
    checked_at: int = 0

    @property
    def left(self) -> bool:
        return self.reviewed < self.total

    @property
    def weak(self) -> list[str]:
        return [x for x in ("commercial", "informational") if self.own.get(x, 0) < PER_INTENT]

    @property
    def target(self) -> int:
        dirty = self.garbage > 0.15 * max(self.reviewed, 1) or self.garbage >= PER_INTENT
        return min(DIRTY if dirty else STANDARD, self.total)

    @property
    def audit_wanted(self) -> bool:
        flat = len(self.yields) >= 2 and max(self.yields[-2:]) <= 1
        return self.audits < LEAST_AUDITS or (self.garbage < PER_INTENT and self.audits < MOST_AUDITS and not flat)


Rule = tuple[Callable[[Facts], object], str, str, str, Callable[[Facts], int]]
_none = lambda f: 0
_small = lambda f: f.source_total <= SMALL
_audit = lambda f: BATCH["audit"] if f.source_total > MEDIUM else min(BATCH["audit"], max(10, f.source_total // 20))

#: (when, status, stage, action, rows of the batch); the first rule that holds is the answer.
RULES: list[Rule] = [
    (lambda f: f.running, "running", "run", "wait", _none),
    (lambda f: f.stage == "cluster_relevance_review" and f.clusters, "continue", "cluster_relevance_review", "cluster-review", lambda f: min(BATCH["clusters"], f.clusters)),
    (lambda f: f.stage == "cluster_relevance_review", "continue", "cluster_relevance_review", "apply-cluster-decisions", _none),
    (lambda f: f.stage in ("quality_review", "knowledge_saved", "learned", "finalized"), "stop", "", "report", _none),
    (lambda f: f.stage == "blocked" or not f.inspected, "blocked", "", "report", _none),
    (lambda f: f.reviewed < min(INITIAL, f.total), "continue", "initial_labeling", "sample", lambda f: min(BATCH["label"], min(INITIAL, f.total) - f.reviewed)),
    (lambda f: _small(f) and f.left, "continue", "direct_labeling", "sample", lambda f: min(BATCH["label"], f.total - f.reviewed)),
    (lambda f: f.config_errors, "continue", "configuration", "configure", _none),
    (lambda f: _small(f) and f.errors, "blocked", "", "report", _none),
    (_small, "continue", "run", "run-auto", _none),
    (lambda f: f.weak and f.left, "continue", "intent_calibration", "sample", lambda f: min(BATCH["label"], f.total - f.reviewed)),
    (lambda f: f.weak, "blocked", "intent_calibration", "report", _none),
    (lambda f: f.priority, "continue", "priority_review", "priority-review", lambda f: min(20, f.priority)),
    (lambda f: f.families, "continue", "intent_family_audit", "family-review", lambda f: min(BATCH["families"], f.families)),
    (lambda f: f.coverage, "continue", "intent_family_coverage", "family-coverage-review", lambda f: min(BATCH["coverage"], f.coverage)),
    (lambda f: any(f.policy.get(k, 0) < n for k, n in LEAST_POLICY.items()), "continue", "intent_policy", "policy-context", lambda f: 8),
    (lambda f: f.refine and f.attempts < ATTEMPTS, "continue", "intent_policy", "policy-context", lambda f: 8),
    (lambda f: f.audit_wanted and f.left, "continue", "relevance_audit", "relevance-review", _audit),
    (lambda f: f.intent_audits < INTENT_AUDITS and f.left, "continue", "intent_audit", "intent-review", _audit),
    (lambda f: f.policy_audits < POLICY_AUDITS and f.left, "continue", "policy_conflict_audit", "policy-conflict-review", _audit),
    (lambda f: f.reviewed < f.target, "continue", "active_review", "review", lambda f: min(20, f.target - f.reviewed)),
    (lambda f: f.errors, "blocked", "", "report", _none),
    (lambda f: f.attempts and f.checked_at < f.reviewed, "continue", "intent_policy", "policy-context", lambda f: 8),
    (lambda f: True, "continue", "run", "run-auto", _none),
]


def next_action(facts: Facts) -> dict:
    for when, status, stage, action, rows in RULES:
        if when(facts):
            return {"status": status, "stage": stage or facts.stage, "action": action, "rows": rows(facts)}
    raise AssertionError("the last rule always holds")
