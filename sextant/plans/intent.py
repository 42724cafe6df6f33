"""Answer an objective: search a stored run and add each result's evidence."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import functions as F

from sextant.errors import SextantError
from sextant.functions.numeric import MAX_RESULTS, MIN_RESULTS, RESULT_RATIO
from sextant.functions.words import locale_key
from sextant.judge import Choice, Judge, Relevance
from sextant.operators import search, tools
from sextant.plans.store import Run, Store, nav_key, now_text

STAT_COLUMNS = ["fan_in", "fan_out", "churn", "defect", "complexity", "bytes"]


class RememberingJudge:
    """Judge whose choices and relevances are kept; a remembered answer uses no tokens."""

    def __init__(self, judge: Judge, entries: dict[str, dict]) -> None:
        self._judge, self.entries, self.model = judge, entries, judge.model

    def review(self, evidence):
        return self._judge.review(evidence)

    def _keep(self, key: str, value: dict) -> None:
        self.entries[key] = {
            "key": key, "model": self.model, "created_at": now_text(), "value": value
        }

    def rank(self, intent: str, node: dict, candidates: list[dict]) -> Choice:
        neutral = sorted(candidates, key=lambda c: locale_key(c["path"]))
        offered = {c["path"]: c["description"] for c in neutral}
        key = nav_key("rank", self.model, intent, offered)
        if key in self.entries:
            return replace(Choice(**self.entries[key]["value"]), input_tokens=0, output_tokens=0)
        choice = self._judge.rank(intent, node, neutral)
        self._keep(key, asdict(choice))
        return choice

    def score(self, intent: str, paths: list[str]) -> Relevance:
        key = nav_key("score", self.model, intent, paths)
        if key in self.entries:
            kept = self.entries[key]["value"]
            return Relevance({path: tuple(pair) for path, pair in kept})
        scored = self._judge.score(intent, paths)
        self._keep(key, [[path, list(pair)] for path, pair in scored.judgments.items()])
        return scored


def default_results(units: int) -> int:
    return min(MAX_RESULTS, max(MIN_RESULTS, int(units * RESULT_RATIO + 0.5)))


def search_map(run: Run, path: str | None) -> search.SearchMap:
    nodes = run.tables["nodes"]
    if path and not nodes.where(F.col("path") == path).limit(1).count():
        raise SextantError("USAGE", f"No map node at {path}.")
    return search.SearchMap(nodes, run.tables["relations"], run.tables["leaders"], path or "")


def stats_of(run: Run, paths: list[str]) -> dict[str, dict]:
    """Evidence of the results; a path without a unit counts as zeros."""
    zero = dict.fromkeys(STAT_COLUMNS, 0)
    if not paths:
        return {}
    rows = run.tables["units"].where(F.col("path").isin(paths)).select(
        "path", "fan_in", "fan_out",
        F.coalesce("history.recent_commits", F.lit(0)).alias("churn"),
        F.coalesce("history.bug_fix_commits", F.lit(0)).alias("defect"),
        F.coalesce("complexity.max_cyclomatic", F.lit(0)).alias("complexity"),
        "bytes",
    )
    found = {row["path"]: {c: row[c] for c in STAT_COLUMNS} for row in rows.collect()}
    return {path: found.get(path, zero) for path in paths}


def run_intent(
    store: Store,
    judge: Judge,
    intent: str,
    run_id: str | None = None,
    path: str | None = None,
    limit: int | None = None,
    budget: int = 12,
    min_confidence: float = 0.2,
    fresh: bool = False,
    on_step=None,
) -> dict:
    run = store.load_run(run_id)
    if run is None:
        raise SextantError("RUN_MISSING", "No scan run found.", "Run a query first.")
    map_ = search_map(run, path)
    entries = {} if fresh else store.load_nav()
    if limit is None:
        limit = default_results(tools.units_in_scope(run.tables["units"], path).count())
    options = search.SearchOptions(limit=limit, budget=budget, min_confidence=min_confidence)
    try:
        result = search.search(map_, intent, RememberingJudge(judge, entries), options, on_step)
    finally:
        store.save_nav(entries)
    stats = stats_of(run, [row["path"] for row in result.opportunities])
    return {
        "run_id": run.id, "model": judge.model, "intent": intent,
        "opportunities": [{**row, "stats": stats[row["path"]]} for row in result.opportunities],
        "steps": result.steps,
        "usage": {"input_tokens": result.input_tokens, "output_tokens": result.output_tokens},
        "stop": result.stop,
    }


def project_fields(view: dict, fields: str | None) -> dict:
    """Keep the listed opportunity fields, in the listed order."""
    if not fields:
        return view
    keys = [key.strip() for key in fields.split(",") if key.strip()]
    rows = [{key: row[key] for key in keys if key in row} for row in view["opportunities"]]
    return {**view, "opportunities": rows}
