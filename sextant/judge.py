"""Pluggable judgments.

A judge answers three things: a review of every unit (a DataFrame job), a choice among a bounded
list of search candidates, and the relevance of a bounded list of paths. The offline judges here
are deterministic; a remote model plugs in as a :class:`CallableJudge`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.words import matched, query_words, symbol_words
from sextant.operators.score import DIMENSIONS

STOP = "__stop__"  # fixed value
RELEVANCE_SCALE = 3.0  # fixed value

ANSWERS_TYPE = "struct<" + ",".join(
    f"{name}:struct<score:double,confidence:double>" for name in DIMENSIONS
) + ">"


@dataclass
class Choice:
    probabilities: dict[str, float]
    choice: str
    confidence: float
    input_tokens: int = 0
    output_tokens: int = 0


@dataclass
class Relevance:
    judgments: dict[str, tuple[float, float]] = field(default_factory=dict)
    input_tokens: int = 0
    output_tokens: int = 0


class Judge(Protocol):
    model: str

    def review(self, evidence: DataFrame) -> DataFrame:
        """Add ``answers, error, input_tokens, output_tokens`` to the evidence rows."""

    def rank(self, intent: str, node: dict, candidates: list[dict]) -> Choice: ...

    def score(self, intent: str, paths: list[str]) -> Relevance: ...


def _share(amount: Column, half: float) -> Column:
    """Saturating share: 0 at zero, one half at ``half``."""
    return amount / (amount + F.lit(half))


def evidence_answers() -> Column:
    """Offline review as closed-form expressions over the evidence columns."""
    fan_in, fan_out = F.col("fan_in").cast("double"), F.col("fan_out").cast("double")
    commits = F.coalesce(F.col("history.commits"), F.lit(0)).cast("double")
    moved = (F.col("recent_commits") + F.col("bug_fix_commits")).cast("double")
    branches = F.col("max_cyclomatic").cast("double")

    def answer(score: Column, confidence: Column) -> Column:
        return F.struct(score.alias("score"), confidence.alias("confidence"))

    return F.struct(
        answer(_share(fan_in, 5.0) * 3.0, (fan_in + 1.0) / (fan_in + 3.0)).alias("criticality"),
        answer(
            _share(fan_in + fan_out, 10.0) * 3.0,
            (fan_in + fan_out + 1.0) / (fan_in + fan_out + 4.0),
        ).alias("blast_radius"),
        answer(F.lit(15.0) / (branches + 5.0), F.lit(10.0) / (branches + 10.0)).alias("cohesion"),
        answer(_share(moved, 4.0) * 3.0, (commits + 1.0) / (commits + 6.0)).alias("change_risk"),
    )


class LexicalJudge:
    """Offline judge: reviews from evidence, ranks and scores by matching words."""

    model = "offline-lexical"

    def review(self, evidence: DataFrame) -> DataFrame:
        return evidence.withColumns(
            {
                "answers": evidence_answers(),
                "error": F.col("error")
                if "error" in evidence.columns
                else F.lit(None).cast("string"),
                "input_tokens": F.lit(0).cast("bigint"),
                "output_tokens": F.lit(0).cast("bigint"),
            }
        )

    def rank(self, intent: str, node: dict, candidates: list[dict]) -> Choice:
        terms = query_words(intent)
        raw = {
            c["path"]: 0.05 + matched(terms, symbol_words(c["path"], c.get("exports") or []))
            for c in candidates
        }
        total = sum(raw.values()) or 1.0
        shares = {path: value / total for path, value in raw.items()}
        best = min(shares, key=lambda path: (-shares[path], path)) if shares else STOP
        hits = max(raw.values(), default=0.0)
        return Choice(shares, best, 0.9 if hits >= 1.0 else 0.3)

    def score(self, intent: str, paths: list[str]) -> Relevance:
        terms = query_words(intent)
        out = {}
        for path in paths:
            share = matched(terms, symbol_words(path, [])) / len(terms) if terms else 0.0
            out[path] = (min(1.0, share), 0.8)
        return Relevance(out)


class CallableJudge:
    """Judge backed by user functions, for instance a client of a remote model.

    ``review_fn(payload)`` gets one unit's payload and returns ``{dimension: (score, confidence)}``
    with optional ``input_tokens`` and ``output_tokens``. It runs inside Spark tasks; an exception
    fails that unit only. Units are spread over ``parallelism`` tasks at least and as many as a
    shuffle has; the cores of the executors bound the number of concurrent callers.
    """

    def __init__(
        self,
        model: str,
        review_fn: Callable[[dict], dict] | None = None,
        rank_fn: Callable[[str, dict, list[dict]], Choice] | None = None,
        score_fn: Callable[[str, list[str]], Relevance] | None = None,
        parallelism: int = 8,
    ) -> None:
        self.model = model
        self._review, self._rank, self._score = review_fn, rank_fn, score_fn
        self._parallelism = parallelism

    def review(self, evidence: DataFrame) -> DataFrame:
        review_fn = self._review
        kept = evidence.drop("error") if "error" in evidence.columns else evidence
        packed = kept.select("path", review_payload(kept.columns).alias("payload"))
        schema = f"path string, answers {ANSWERS_TYPE}, error string, " \
                 "input_tokens bigint, output_tokens bigint"

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for path, payload in zip(batch["path"], batch["payload"]):
                    try:
                        result = review_fn(json.loads(payload))
                        answers = {
                            name: {
                                "score": float(result[name][0]),
                                "confidence": float(result[name][1]),
                            }
                            for name in DIMENSIONS
                        }
                        rows.append(
                            (path, answers, None, int(result.get("input_tokens", 0)),
                             int(result.get("output_tokens", 0)))
                        )
                    except Exception as error:  # one unit's failure stays its own
                        rows.append((path, None, str(error) or type(error).__name__, 0, 0))
                yield pd.DataFrame(
                    rows,
                    columns=["path", "answers", "error", "input_tokens", "output_tokens"],
                )

        tasks = int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = packed.repartition(max(self._parallelism, tasks), "path")
        answered = spread.mapInPandas(call, schema)
        return kept.join(answered, "path")

    def rank(self, intent: str, node: dict, candidates: list[dict]) -> Choice:
        return self._rank(intent, node, candidates)

    def score(self, intent: str, paths: list[str]) -> Relevance:
        return self._score(intent, paths) if self._score else Relevance()


def metered_judge(parallelism: int = 8) -> CallableJudge:
    """Offline judge that reports the size of what it reads as tokens (four characters each)."""
    words = LexicalJudge()

    def review(payload: dict) -> dict:
        unit = payload["unit"]
        reach = unit["fan_in"] / (unit["fan_in"] + 5.0) * 3.0
        branches = (unit["complexity"] or {}).get("max_cyclomatic") or 0
        return {
            "criticality": (reach, 0.6), "blast_radius": (reach, 0.6),
            "cohesion": (15.0 / (branches + 5.0), 0.6), "change_risk": (1.5, 0.4),
            "input_tokens": len(json.dumps(payload)) // 4, "output_tokens": 40,
        }

    def rank(intent: str, node: dict, candidates: list[dict]) -> Choice:
        choice = words.rank(intent, node, candidates)
        choice.input_tokens = sum(len(c["description"]) for c in candidates) // 4
        choice.output_tokens = 8 * len(candidates)
        return choice

    def score(intent: str, paths: list[str]) -> Relevance:
        scored = words.score(intent, paths)
        scored.input_tokens = sum(len(path) + len(intent) for path in paths) // 4
        scored.output_tokens = 8 * len(paths)
        return scored

    return CallableJudge("offline-metered", review, rank, score, parallelism)


DEPENDENT_SAMPLE = 20  # fixed value


def review_payload(columns: list[str]) -> Column:
    """JSON a model reviews: content, graph, complexity and rounded history of one unit."""
    have = set(columns)

    def get(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    history = F.when(
        F.col("history").isNotNull(),
        F.struct(
            F.col("history.commits").alias("commits"),
            F.col("history.recent_commits").alias("recent_commits"),
            F.col("history.authors").alias("authors"),
            (F.floor(F.col("history.primary_author_share") * 100 + 0.5) / 100.0).alias(
                "primary_author_share"
            ),
            F.col("history.bug_fix_commits").alias("bug_fix_commits"),
            F.col("history.last_modified").alias("last_modified"),
            F.col("history.couplings.path").alias("coupled_with"),
        ),
    )
    return F.to_json(
        F.struct(
            F.struct(
                F.col("path"), get("kind", "string").alias("kind"),
                get("lines", "int").alias("lines"), get("content", "string").alias("content"),
                get("imports", "array<string>").alias("imports"),
                F.col("fan_in"), F.col("fan_out"),
                get("dependents_sample", "array<string>").alias("dependents"),
                get("exports", "array<string>").alias("exports"),
                F.col("complexity_facts").alias("complexity"), history.alias("history"),
            ).alias("unit")
        ),
        {"ignoreNullFields": "false"},
    )
