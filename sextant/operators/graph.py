"""Import edges and fan-in / fan-out.

Dependents stay an edge table: a hub file imported by a third of the repository would otherwise
be one row with an array of that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.digest import lane_sums, lanes_digest


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges ``src -> dst`` without self-edges and repeats."""
    return edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def _ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: where it leads into, and where it comes from."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("path"), F.lit(None).cast("string").alias("dependent")),
            F.struct(F.col("dst").alias("path"), F.col("src").alias("dependent")),
        )
    )
    return edges.select(ends.alias("end")).select("end.path", "end.dependent")


def fan_counts(edges: DataFrame, *extra: Column) -> DataFrame:
    """fan_in and fan_out per file, and what else is aggregated over ``dependent``, in one
    exchange over distinct edges."""
    return _ends(edges).groupBy("path").agg(
        F.count("dependent").alias("fan_in"),
        F.count_if(F.col("dependent").isNull()).alias("fan_out"),
        *extra,
    )


def fan_in_out(units: DataFrame, edges: DataFrame, *extra: Column) -> DataFrame:
    """Every unit with its fan-in and fan-out, zeros included."""
    counted = fan_counts(edges, *extra)
    others = [name for name in counted.columns if name not in ("path", "fan_in", "fan_out")]
    return units.select("path").join(counted, "path", "left").select(
        "path",
        F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
        *others,
    )


def dependents(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("path"), F.col("src").alias("dependent"))


def graph_fingerprints(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Digest of fan-in, fan-out and the set of dependents of every unit."""
    summed = fan_in_out(units, edges, *lane_sums(F.col("dependent")))
    return summed.select(
        "path",
        lanes_digest(F.col("fan_in"), 16, F.col("fan_out")).alias("graph_fingerprint"),
    )
