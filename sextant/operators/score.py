"""Percentile ranks, judged signals, priority and drivers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.numeric import clamp01, half_up
from sextant.session import cut_lineage

# The judged dimensions, in order.
DIMENSIONS = ["criticality", "blast_radius", "cohesion", "change_risk"]


@dataclass(frozen=True)
class Policy:
    """Scale, floor, weights; the weights are in driver order."""

    scale: float = 3.0
    uncertain_floor: float = 0.5
    driver_count: int = 2
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "criticality": 1.2,
            "blast_radius": 1.2,
            "change_risk": 0.8,
            "low_cohesion": 0.6,
            "churn": 1.0,
            "defect_history": 1.0,
            "complexity": 1.0,
        }
    )


DEFAULT_POLICY = Policy()

BUCKET_WIDTH = 65536


def rank_table(values: DataFrame) -> DataFrame:
    """Tie-averaged percentile rank of each distinct value of each metric.

    ``values`` has one row per unit with ``metric, value`` (whole numbers). Rows are first
    counted per distinct value, and the running count is taken in two levels: inside buckets of
    65,536 neighbouring values, and over the bucket totals, of which a 32-bit range has at most
    65,536. No window sees more rows than that, whatever the number of units.
    """
    counted = (
        values.groupBy("metric", F.col("value").cast("bigint").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.floor(F.col("value") / F.lit(BUCKET_WIDTH)))
    )
    inside = (
        Window.partitionBy("metric", "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy("metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        counted.groupBy("metric", "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .select(
            "metric", "bucket",
            F.coalesce(F.sum("bucket_n").over(earlier), F.lit(0)).alias("before"),
            F.sum("bucket_n").over(Window.partitionBy("metric")).alias("total"),
        )
    )
    ranked = counted.withColumn("upto", F.sum("n").over(inside)).join(totals, ["metric", "bucket"])
    below = F.col("before") + F.col("upto") - F.col("n")
    not_above = F.col("before") + F.col("upto")
    return ranked.select(
        "metric", "value",
        F.when(F.col("n") == F.col("total"), F.lit(0.0))
        .otherwise((below + not_above - 1) / F.lit(2.0) / (F.col("total") - 1))
        .alias("rank"),
    )


def percentile_ranks(units: DataFrame, metrics: list[str], key: str = "path") -> DataFrame:
    """Add ``<metric>_rank`` for every metric column of ``units``.

    The rank table has one row per distinct value and is stored, so the join is planned from its
    true size. Most units may share one value (zero above all): that partition of the join is split
    at run time.
    """
    long = units.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value"))
                    for m in metrics
                ]
            )
        ).alias("sample")
    ).select("sample.*")
    ranks, out = cut_lineage(rank_table(long)), units
    for metric in metrics:
        side = ranks.where(F.col("metric") == metric).select(
            F.col("value").alias(f"{metric}_value"), F.col("rank").alias(f"{metric}_rank")
        )
        same = F.col(metric).cast("bigint") == F.col(f"{metric}_value")
        out = out.join(side, same).drop(f"{metric}_value")
    return out


def computed_signals(units: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """churn, defect and complexity on the policy scale.

    ``units`` has ``path, recent_commits, bug_fix_commits, max_cyclomatic`` with zeros filled.
    """
    ranked = percentile_ranks(units, ["recent_commits", "bug_fix_commits", "max_cyclomatic"])
    scale = F.lit(policy.scale)
    return ranked.withColumns(
        {
            "churn": F.col("recent_commits_rank") * scale,
            "defect": F.col("bug_fix_commits_rank") * scale,
            "complexity": F.col("max_cyclomatic_rank") * scale,
        }
    ).drop("recent_commits_rank", "bug_fix_commits_rank", "max_cyclomatic_rank")


def _dimension_weight(policy: Policy, name: str) -> float:
    return policy.weights["low_cohesion" if name == "cohesion" else name]


def judged_confidence(answers: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Weighted mean confidence of the judged dimensions."""
    weighted, total = F.lit(0.0), 0.0
    for name in DIMENSIONS:
        weight = _dimension_weight(policy, name)
        weighted = weighted + F.lit(weight) * answers[name]["confidence"]
        total += weight
    return weighted / F.lit(total)


def uncertain_dimensions(answers: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    flags = [
        F.when(answers[name]["confidence"] < policy.uncertain_floor, F.lit(name))
        for name in DIMENSIONS
    ]
    return F.array_compact(F.array(*flags))


def factor_values(signals: dict[str, Column], policy: Policy = DEFAULT_POLICY) -> dict[str, Column]:
    scale = F.lit(policy.scale)
    values = {
        "criticality": signals["criticality"] / scale,
        "blast_radius": signals["blast_radius"] / scale,
        "change_risk": signals["change_risk"] / scale,
        "low_cohesion": (scale - signals["cohesion"]) / scale,
        "churn": signals["churn"] / scale,
        "defect_history": signals["defect"] / scale,
        "complexity": signals["complexity"] / scale,
    }
    return {name: clamp01(value) for name, value in values.items()}


def weighted_factors(df: DataFrame, signals: dict[str, Column], policy: Policy) -> DataFrame:
    """Weighted factor values, their sum, and the priority from 0 to 100."""
    values = factor_values(signals, policy)
    parts = {f"_{name}": F.lit(policy.weights[name]) * value for name, value in values.items()}
    weighted, total = F.lit(0.0), 0.0
    for name in policy.weights:
        weighted = weighted + F.col(f"_{name}")
        total += policy.weights[name]
    return (
        df.withColumns(parts)
        .withColumn("_weighted", weighted)
        .withColumn("priority", half_up(F.col("_weighted") / F.lit(total), 1000, 10))
    )


def drivers_of(policy: Policy) -> Column:
    """Largest positive contribution shares; equal shares keep factor order."""
    shares = F.array(
        *[
            F.struct(
                (-(F.col(f"_{name}") / F.col("_weighted"))).alias("share"),
                F.lit(at).alias("at"),
                F.lit(name).alias("name"),
            )
            for at, name in enumerate(policy.weights)
        ]
    )
    positive = F.filter(shares, lambda s: s["share"] < 0)
    top = F.slice(F.array_sort(positive), 1, policy.driver_count)
    return F.when(F.col("_weighted") == 0, F.array().cast("array<string>")).otherwise(
        F.transform(top, lambda s: s["name"])
    )


def score_units(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Fuse ``answers`` with churn, defect and complexity into the scored columns."""
    answers = F.col("answers")
    signals = {name: answers[name]["score"] for name in DIMENSIONS}
    signals |= {name: F.col(name) for name in ("churn", "defect", "complexity")}
    scored = weighted_factors(df, signals, policy).withColumns(
        {
            "confidence": judged_confidence(answers, policy),
            "drivers": drivers_of(policy),
            "uncertain": uncertain_dimensions(answers, policy),
        }
    )
    return scored.drop("_weighted", *[f"_{name}" for name in policy.weights])
