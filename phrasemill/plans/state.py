"""Job folders: configuration and state as small JSON files, replaced as a whole; a lock that a dead owner does not keep."""

from __future__ import annotations

import json
import os
import re
import socket
import uuid
from datetime import datetime, timezone

from ..operators.decide import Settings
from ..sources import files

SECTIONS = ("topic", "intent", "clustering")


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def flatten(config: dict, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted keys and values; lists joined by ' | '."""
    out: list[tuple[str, str]] = []
    for key, value in config.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            out += flatten(value, f"{name}.")
        else:
            out.append((name, " | ".join(map(str, value)) if isinstance(value, list) else str(value)))
    return out


def check_config(config: dict) -> list[str]:
    """What is wrong with a configuration."""
    errors = [f"{s} must be an object" for s in SECTIONS if not isinstance(config.get(s), dict)]
    if not errors and config["intent"].get("default") not in ("commercial", "informational"):
        errors.append("intent.default must be commercial or informational")
    return errors


def settings_of(config: dict) -> Settings:
    """The decision's settings of a configuration; what it lacks keeps its default."""
    intent, policy, relevance = (config.get(k) or {} for k in ("intent", "intent_policy", "relevance"))
    rules = intent.get("family_rules") or {}
    base = Settings()
    threshold = float(relevance.get("garbage_threshold", base.garbage_threshold))
    return Settings(
        default_intent=intent.get("default", base.default_intent),
        margin=float(intent.get("informational_decision_margin", base.margin)),
        strong_margin=float(intent.get("strong_informational_decision_margin", base.strong_margin)),
        weak_margin=float(intent.get("weak_question_informational_margin", intent.get("strong_informational_decision_margin", base.weak_margin))),
        evidence_margin=float(policy.get("informational_evidence_margin", base.evidence_margin)),
        family_tolerance=float(intent.get("family_override_tolerance", base.family_tolerance)),
        minimum_similarity=float(policy.get("minimum_similarity", base.minimum_similarity)),
        policy_strength=float(policy.get("strength", base.policy_strength)),
        garbage_threshold=threshold,
        quarantine_threshold=max(0.05, threshold - float(relevance.get("quarantine_margin", 0.10))),
        **{k: tuple(intent.get(k, ())) for k in ("commercial_markers", "informational_markers", "weak_question_markers")},
        **{f"{k}_families": tuple(rules.get(k, ())) for k in ("commercial", "informational", "neutral")},
    )


class Job:
    """A folder with config.json, state.json and Parquet tables (sheet, candidates, decided, ...), in any file system that Spark reaches."""

    def __init__(self, folder: str | os.PathLike) -> None:
        self.folder = str(folder).rstrip("/")

    @classmethod
    def create(cls, root: str | os.PathLike, name: str, config: dict) -> Job:
        job = cls(f"{str(root).rstrip('/')}/{name}")
        files.make_folder(job.folder)
        config.setdefault("workflow_job_id", f"seo-{uuid.uuid4().hex[:16]}")
        job.save_config(config)
        return job

    @classmethod
    def find(cls, root: str | os.PathLike, job_id: str) -> Job:
        """The one job under root with that id, which a workbook carries."""
        if not re.fullmatch("seo-[a-f0-9]{16}", job_id or ""):
            raise ValueError(f"{job_id} is no job id")
        jobs = [cls(f"{root}/{name}") for name in files.names(str(root)) if files.exists(f"{root}/{name}/config.json")]
        found = [j for j in jobs if j.config().get("workflow_job_id") == job_id]
        if len(found) != 1:
            raise ValueError(f"{len(found)} jobs have the id {job_id}")
        return found[0]

    @property
    def name(self) -> str:
        return self.folder.rpartition("/")[2]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        return files.exists(self.path(name))

    def read_json(self, name: str) -> dict:
        return json.loads(files.read_text(self.path(name)))

    def write_json(self, name: str, value: object) -> None:
        files.replace_text(self.path(name), json.dumps(value, ensure_ascii=False, indent=2, default=str))

    def config(self) -> dict:
        return self.read_json("config.json")

    def save_config(self, config: dict) -> None:
        self.write_json("config.json", config)

    def state(self) -> dict:
        return self.read_json("state.json") if self.has("state.json") else {}

    def update(self, stage: str | None = None, **values) -> dict:
        state = {**self.state(), **values, "updated_at": now()}
        if stage:
            state["stage"] = stage
        self.write_json("state.json", state)
        return state

    # -- lock ---------------------------------------------------------------------------------------------------------

    LOCK = ".run.lock.json"

    def lock_owner(self) -> dict | None:
        """The owner of the run lock, unless it is a process of this machine that has ended. Of other machines nothing is known, so theirs holds."""
        try:
            owner = self.read_json(self.LOCK)
            if owner.get("host", socket.gethostname()) == socket.gethostname():
                os.kill(int(owner["pid"]), 0)
        except PermissionError:
            return owner
        except (OSError, ValueError, KeyError):
            return None
        return owner

    def acquire(self) -> str:
        """Takes the lock or raises RuntimeError; a lock whose owner is gone is taken over."""
        token = uuid.uuid4().hex
        for _ in range(2):
            try:
                files.create_text(self.path(self.LOCK), json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "token": token, "started_at": now()}))
                return token
            except FileExistsError:
                if self.lock_owner():
                    raise RuntimeError("a run is active") from None
                files.delete(self.path(self.LOCK))
        raise RuntimeError("the lock cannot be taken")

    def release(self, token: str) -> None:
        if self.has(self.LOCK) and self.read_json(self.LOCK).get("token") == token:
            files.delete(self.path(self.LOCK))


def _numbers(folder: str, stem: str) -> dict[int, str]:
    return {int(m[1]): n for n in files.names(folder) if (m := re.match(rf"{re.escape(stem)}_run_(\d{{3,}})", n))}


def next_version(folder: str, stem: str, suffix: str = "") -> str:
    """stem_run_001, 002, ... : the first number above those present."""
    return f"{folder}/{stem}_run_{max(_numbers(folder, stem), default=0) + 1:03d}{suffix}"


def latest_version(folder: str, stem: str) -> str | None:
    found = {n: name for n, name in _numbers(folder, stem).items()}
    return f"{folder}/{stem}_run_{max(found):03d}" if found else None
