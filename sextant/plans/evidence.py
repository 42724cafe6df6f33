"""Join the evidence of every unit and score it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.judge import Judge
from sextant.operators import packages
from sextant.operators.graph import fan_in_out
from sextant.operators.score import DEFAULT_POLICY, Policy, computed_signals, score_units

HISTORY_FIELDS = [
    "commits", "recent_commits", "authors", "recent_authors", "primary_author_share",
    "bug_fix_commits", "revert_commits", "last_modified", "first_seen", "sum_coupling",
    "couplings",
]
EMPTY_STRINGS = "array<string>"


def targets(units: DataFrame) -> DataFrame:
    """Only source units are judged and ranked; tests still count in graph and history."""
    return units.where(F.col("kind") == "source")


def metrics(units: DataFrame, churn: DataFrame) -> DataFrame:
    """The three ranked counters of every source unit, zeros filled."""
    counters = churn.select("path", "recent_commits", "bug_fix_commits")
    return (
        targets(units)
        .select("path", F.col("complexity_facts.max_cyclomatic").alias("max_cyclomatic"))
        .join(counters, "path", "left")
        .na.fill(0, ["max_cyclomatic", "recent_commits", "bug_fix_commits"])
    )


def gather(
    units: DataFrame, edges: DataFrame | packages.Links, history: DataFrame,
    churn: DataFrame | None = None,
) -> DataFrame:
    """Source units with graph, history and computed signals.

    All joins share the key ``path``. The ranks only need counters, so they are computed from
    ``churn`` where the caller has it apart from the full history.
    """
    whole = isinstance(edges, packages.Links)
    fans = packages.fan_in_out(units, edges) if whole else fan_in_out(units, edges)
    packed = history.select("path", F.struct(*HISTORY_FIELDS).alias("history"))
    signals = computed_signals(metrics(units, history if churn is None else churn))
    return (
        targets(units)
        .join(fans, "path")
        .join(packed, "path", "left")
        .join(signals, "path")
    )


def unit_rows(reviewed: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Scored rows; a failed review leaves zeros, empty lists and the error text."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    scored = score_units(reviewed, policy)

    def unless_failed(column: Column, otherwise: Column) -> Column:
        return F.when(failed, otherwise).otherwise(column)

    none = F.array().cast(EMPTY_STRINGS)
    signals = F.struct(
        F.col("answers.criticality.score").alias("criticality"),
        F.col("answers.blast_radius.score").alias("blast_radius"),
        F.col("answers.cohesion.score").alias("cohesion"),
        F.col("answers.change_risk.score").alias("change_risk"),
        F.col("churn"), F.col("defect"), F.col("complexity"),
    )
    return scored.select(
        "path", "kind", "language", "bytes", "hash",
        unless_failed(F.col("priority"), F.lit(0.0)).alias("priority"),
        unless_failed(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        unless_failed(F.col("drivers"), none).alias("drivers"),
        unless_failed(F.col("uncertain"), none).alias("uncertain"),
        F.when(~failed, signals).alias("signals"),
        "fan_in", "fan_out", "type_imports", "exports", "type_exports",
        "history", F.col("complexity_facts").alias("complexity"),
        F.when(~failed, F.col("answers")).alias("answers"),
        "error",
    )


def scan_units(
    units: DataFrame,
    edges: DataFrame,
    history: DataFrame,
    judge: Judge,
    policy: Policy = DEFAULT_POLICY,
    churn: DataFrame | None = None,
) -> DataFrame:
    return unit_rows(judge.review(gather(units, edges, history, churn)), policy)


def counts(run_units: DataFrame, skipped: Column | None = None) -> DataFrame:
    failed = F.count_if(F.coalesce(F.col("error"), F.lit("")) != "")
    total = F.count(F.lit(1))
    return run_units.agg(
        total.alias("total"),
        (total - failed).alias("scored"),
        failed.alias("failed"),
        (F.lit(0).cast("bigint") if skipped is None else skipped).alias("skipped"),
    )
