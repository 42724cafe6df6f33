"""Usage ledger and economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.numeric import estimate_cost
from sextant.session import cut_lineage


def usage_rows(ledger: DataFrame) -> DataFrame:
    """Runs with their estimated cost."""
    return ledger.withColumn(
        "cost_usd", estimate_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("model"))
    )


def latest_runs(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("started_at"), F.asc("id")).limit(limit)


def usage_totals(rows: DataFrame) -> DataFrame:
    """Totals over all runs, whatever number is printed."""
    return rows.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("cached"), F.lit(0)).alias("cached"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def exact_median(values: DataFrame, column: str) -> DataFrame:
    """Median (mean of the middle two); 0 without values. Values are combined per distinct value
    ahead of the exchange."""
    return values.agg(F.coalesce(F.median(column), F.lit(0.0)).alias("median"))


def _summary(
    queries: DataFrame, cold_in: Column, warm_in: Column, built_out: Column, hit_rate: Column
) -> DataFrame:
    sums = queries.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("query_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("query_output_tokens"),
        F.coalesce(F.avg("input_tokens"), F.lit(0.0)).alias("query_mean_tokens"),
        F.max("model").alias("model"),
    )
    both = sums.withColumns(
        {
            "median": exact_median(queries, "input_tokens").scalar(), "cold_in": cold_in,
            "warm_in": warm_in, "built_out": built_out, "hit_rate": hit_rate,
        }
    )
    total_in = F.col("cold_in") + F.col("warm_in") + F.col("query_input_tokens")
    total_out = F.col("built_out") + F.col("query_output_tokens")
    return both.select(
        F.col("cold_in").alias("cold_input_tokens"),
        F.col("warm_in").alias("warm_input_tokens"),
        "query_input_tokens",
        total_in.alias("total_input_tokens"),
        "query_mean_tokens",
        F.col("median").alias("query_median_tokens"),
        F.col("hit_rate").alias("warm_cache_hit_rate"),
        estimate_cost(total_in, total_out, F.coalesce("model", F.lit(""))).alias("total_cost_usd"),
    )


def economics(queries: DataFrame, cold: dict | None, warm: dict | None) -> DataFrame:
    """Summary of a benchmark: builds (plain numbers) and the table of query costs.

    ``queries`` has ``input_tokens, output_tokens, model``.
    """
    cold, warm = cold or {}, warm or {}
    tried = warm.get("calls", 0) + warm.get("cached", 0)
    return _summary(
        queries, F.lit(cold.get("input_tokens", 0)), F.lit(warm.get("input_tokens", 0)),
        F.lit(cold.get("output_tokens", 0) + warm.get("output_tokens", 0)),
        F.lit(warm.get("cached", 0) / tried if tried else 0.0),
    )


def first_runs(ledger: DataFrame, user: str = "user") -> DataFrame:
    """The first two runs of every user and model: ``at`` is 1 for the cold build, 2 for the warm
    one. The cut is a group limit ahead of the exchange, so a user with most runs sends two a task."""
    order = Window.partitionBy(user, "model").orderBy("started_at", "id")
    return ledger.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 2)


def ledger_economics(ledger: DataFrame, user: str = "user") -> DataFrame:
    """:func:`economics` of a ledger: a user's first run with a model is a cold build, the second a
    warm one, and all later ones are queries."""
    builds = cut_lineage(first_runs(ledger, user))
    queries = ledger.join(builds.select("id"), "id", "left_anti")

    def total(name: str, *at: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("at").isin(*at), F.col(name))), F.lit(0))

    tried = total("calls", 2) + total("cached", 2)
    sums = builds.agg(
        F.struct(
            total("input_tokens", 1).alias("cold_in"), total("input_tokens", 2).alias("warm_in"),
            total("output_tokens", 1, 2).alias("built_out"),
            F.when(tried > 0, total("cached", 2) / tried).otherwise(F.lit(0.0)).alias("hit_rate"),
        ).alias("builds")
    ).scalar()
    return _summary(queries, *(sums[name] for name in ("cold_in", "warm_in", "built_out", "hit_rate")))
