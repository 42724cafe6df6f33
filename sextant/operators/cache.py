"""Judgment cache: keys, hits and misses, pruning, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.digest import answer_key, digest_fields, lane_sums, lanes_digest

NAV_CACHE_LIMIT = 2000  # fixed value


def state_fingerprint() -> Column:
    """Digest of a unit's evidence: graph, history and complexity.

    Reverts, first sight, recent authors and imports are left out on purpose.
    """
    h, c = "history.", "complexity_facts."
    partners = F.array_join(F.array_sort(F.col(h + "couplings.path")), ",")
    return digest_fields(
        [
            F.col("graph_fingerprint"),
            F.col(h + "commits"), F.col(h + "recent_commits"), F.col(h + "authors"),
            F.floor(F.col(h + "primary_author_share") * 100 + 0.5),
            F.col(h + "bug_fix_commits"), F.col(h + "last_modified"), partners,
            F.col(c + "functions"), F.col(c + "total_cyclomatic"), F.col(c + "max_cyclomatic"),
            F.col(c + "max_nesting"), F.col(c + "max_function_lines"),
        ],
        16,
    )


def with_answer_keys(evidence: DataFrame, graph_prints: DataFrame, model: str) -> DataFrame:
    keyed = evidence.join(graph_prints, "path").withColumn("state", state_fingerprint())
    return keyed.withColumn(
        "key", answer_key(F.col("hash"), F.lit(model), F.col("state"))
    ).drop("graph_fingerprint")


def repository_fingerprint(units: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: digest over all ``path:hash`` and ``path:skipped`` entries, in no order."""
    entries = units.select(F.concat_ws(":", "path", "hash").alias("entry")).unionByName(
        skipped.select(F.concat(F.col("path"), F.lit(":skipped")).alias("entry"))
    )
    return entries.agg(F.count(F.lit(1)).alias("entries"), *lane_sums(F.col("entry"))).select(
        lanes_digest(F.col("entries"), 32).alias("fingerprint"), "entries"
    )


def hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Units whose key is cached, with the cached answers.

    Copies of one file share a key, so one key may have many units; the cache side is unique.
    """
    known = cache.select(
        "key", F.col("answers").alias("answers"), F.col("model").alias("cached_model")
    )
    return keyed.join(known, "key")


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("key"), "key", "left_anti")


def pruned(cache: DataFrame, used_keys: DataFrame) -> DataFrame:
    """Entries some unit of this run used."""
    return cache.join(used_keys.select("key").distinct(), "key", "left_semi")


def newest(entries: DataFrame, limit: int = NAV_CACHE_LIMIT) -> DataFrame:
    """Navigation entries kept on save, newest first."""
    return entries.orderBy(F.desc("created_at"), F.asc("key")).limit(limit)


def accounting(outcomes: DataFrame) -> DataFrame:
    """Calls, cache hits, failures and tokens of a run, from ``hit, error`` and token columns."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    fresh = ~F.col("hit")
    return outcomes.agg(
        F.count_if(fresh & ~failed).alias("calls"),
        F.count_if("hit").alias("cached"),
        F.count_if(fresh & failed).alias("failed"),
        F.coalesce(F.sum(F.when(fresh, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(fresh, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
    )
