"""Settings of model tasks: defaults by rule, overlaid with a stored table of keys; secrets come from the environment alone."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import functions as F

from .artifacts import Artifacts

#: Tasks, those that make vectors, other names by which tasks go, and the defaults of a task's settings.
TASKS = ["jd_skill", "jd_struct", "resume_struct", "kb_embedding", "evidence_embedding", "network_advice"]
ALIASES = {"skill_extraction": "jd_skill", "jd_skill_extraction": "jd_skill", "jd_structuring": "jd_struct", "resume_structuring": "resume_struct", "candidate_embedding": "kb_embedding", "network_insight": "network_advice"}
TEXT_MODEL = {"local_model": "qwen3:8b", "local_url": "http://localhost:11434/api/generate", "remote_model": "gpt-5.4"}
VECTOR_MODEL = {"local_model": "qwen3-embedding:8b", "local_url": "http://localhost:11434/api/embeddings", "remote_model": "text-embedding-3-small"}
SECRET = "remote_api_key"


def defaults() -> dict[str, object]:
    """task_name: value of every task's settings."""
    own = lambda t: {"provider": "local", "remote_enabled": False, "remote_base_url": ""} | (VECTOR_MODEL if t.endswith("_embedding") else TEXT_MODEL)
    return {f"{t}_{k}": v for t in TASKS for k, v in own(t).items()}


@dataclass(frozen=True)
class TaskConfig:
    """What a task's client needs; model and url are those of its provider."""

    task: str
    provider: str
    model: str
    url: str
    remote_enabled: bool
    fallback_model: str
    secret: str


def load(store: Artifacts) -> dict[str, object]:
    """Defaults under what is stored; values that do not parse keep their default."""
    out, kept = defaults(), store.load("settings")
    for r in kept.collect() if kept is not None else []:  # a row a setting
        try:
            out[r["key"]] = json.loads(r["value"])
        except (TypeError, ValueError):
            pass
    return out


def save(store: Artifacts, changes: dict[str, object]) -> dict[str, object]:
    """The settings with changes, stored as the next version; secrets are never stored."""
    out = {k: v for k, v in (load(store) | changes).items() if not k.endswith(SECRET)}
    store.save("settings", store.spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in sorted(out.items())], "key string, value string").repartition(1).sortWithinPartitions(F.col("key")))
    return out


def of_task(settings: dict[str, object], task: str) -> TaskConfig:
    """A task's settings by its name or an older one; an unknown task is local with no model. Its secret is the environment's <TASK>_API_KEY."""
    name = ALIASES.get(task, task)
    get = lambda k, otherwise="": settings.get(f"{name}_{k}", otherwise)
    remote = get("provider", "local") == "remote"
    return TaskConfig(name, str(get("provider", "local")), str(get("remote_model" if remote else "local_model")), str(get("remote_base_url" if remote else "local_url")), bool(get("remote_enabled", False)), str(get("remote_model")), os.environ.get(f"{name.upper()}_API_KEY", ""))
