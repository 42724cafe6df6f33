"""Run tables, the latest-run pointer and the caches of a repository.

Every run is a folder of Parquet tables that is written once; the pointer is moved last, so a
reader never sees half a run and a lost executor only repeats its tasks. The judgment cache is
written to a new folder per run as well, since it is read while its successor is computed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sextant.judge import ANSWERS_TYPE
from sextant.operators.cache import NAV_CACHE_LIMIT

RUN_TABLES = ["units", "edges", "uses", "members", "skipped", "nodes", "relations", "leaders"]
CACHE_SCHEMA = (
    f"key string, hash string, path string, model string, state string, created_at string, "
    f"answers {ANSWERS_TYPE}"
)


def now_text() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def repo_key(root: str) -> str:
    absolute = os.path.abspath(root)
    name = re.sub(r"[^a-zA-Z0-9._-]+", "-", os.path.basename(absolute)).strip("-") or "repo"
    return f"{name}-{hashlib.sha256(absolute.encode()).hexdigest()[:8]}"


def state_dir(root: str, env: dict[str, str] | None = None) -> str:
    """Exact folder, else a folder per repository below the home folder."""
    env = dict(os.environ) if env is None else env
    if env.get("SEXTANT_STATE_DIR"):
        return env["SEXTANT_STATE_DIR"]
    home = env.get("SEXTANT_HOME") or os.path.join(os.path.expanduser("~"), ".sextant")
    return os.path.join(home, "repos", repo_key(root))


def read_json(path: str | Path):
    """Content of a small JSON file; missing or malformed reads as None."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def write_json(path: str | Path, value) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_suffix(target.suffix + ".new")
    draft.write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
    os.replace(draft, target)


@dataclass
class Run:
    """A stored run: its summary and its tables."""

    record: dict
    tables: dict[str, DataFrame]

    @property
    def id(self) -> str:
        return self.record["id"]


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def run_folder(self, run_id: str) -> str:
        return os.path.join(self.folder, "runs", run_id)

    def write_table(self, run_id: str, name: str, df: DataFrame) -> DataFrame:
        """Write a table of a run and go on from what was written."""
        path = os.path.join(self.run_folder(run_id), name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish_run(self, record: dict) -> None:
        write_json(os.path.join(self.run_folder(record["id"]), "run.json"), record)
        write_json(
            os.path.join(self.folder, "latest.json"),
            {"id": record["id"], "started_at": record["started_at"]},
        )

    def load_run(self, run_id: str | None = None) -> Run | None:
        pointer = {"id": run_id} if run_id else read_json(os.path.join(self.folder, "latest.json"))
        if not pointer or not pointer.get("id"):
            return None
        folder = self.run_folder(pointer["id"])
        record = read_json(os.path.join(folder, "run.json"))
        if record is None:
            return None
        tables = {
            name: self.spark.read.parquet(os.path.join(folder, name)) for name in RUN_TABLES
        }
        return Run(record, tables)

    def ledger(self) -> DataFrame | None:
        """Usage of all runs, read as one table of their summaries."""
        pattern = os.path.join(self.folder, "runs", "*", "run.json")
        if next(Path(self.folder).glob("runs/*/run.json"), None) is None:
            return None
        schema = (
            "id string, started_at string, model string, counts struct<total:bigint>, "
            "usage struct<calls:bigint,cached:bigint,failed:bigint,input_tokens:bigint,"
            "output_tokens:bigint>"
        )
        rows = self.spark.read.schema(schema).json(pattern, multiLine=True)
        return rows.where("id is not null").selectExpr(
            "id", "started_at", "model", "counts.total as units", "usage.calls", "usage.cached",
            "usage.failed", "usage.input_tokens", "usage.output_tokens",
        )

    def load_cache(self) -> DataFrame:
        pointer = read_json(os.path.join(self.folder, "cache.json"))
        if not pointer:
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self.spark.read.parquet(os.path.join(self.folder, "cache", pointer["version"]))

    def save_cache(self, entries: DataFrame, version: str) -> None:
        entries.write.mode("overwrite").parquet(os.path.join(self.folder, "cache", version))
        write_json(os.path.join(self.folder, "cache.json"), {"version": version})

    def load_nav(self) -> dict[str, dict]:
        return read_json(os.path.join(self.folder, "nav-cache.json")) or {}

    def save_nav(self, entries: dict[str, dict]) -> None:
        write_json(os.path.join(self.folder, "nav-cache.json"), prune_nav(entries))


def prune_nav(entries: dict[str, dict], limit: int = NAV_CACHE_LIMIT) -> dict[str, dict]:
    """Newest navigation entries first, up to the limit."""
    newest = sorted(entries.values(), key=lambda entry: entry["created_at"], reverse=True)
    return {entry["key"]: entry for entry in newest[:limit]}


def nav_key(kind: str, model: str, intent: str, payload) -> str:
    text = json.dumps(
        {"kind": kind, "model": model, "intent": intent, "payload": payload},
        separators=(",", ":"), ensure_ascii=False,
    )
    return hashlib.sha256(text.encode()).hexdigest()[:32]
