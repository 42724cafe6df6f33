"""Positions in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths as P
from sextant.session import cut_lineage


def with_positions(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``position``, from 1, in the given order.

    Rows are dealt out by ranges of the order, which are stored, since ranges come from a sample and
    would not be the same twice. A row's position is its place in its range plus the rows of the
    ranges before, of which there is one count each.
    """
    ranged = cut_lineage(
        rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    before = (
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_place", place).join(offsets, "_range")
    return numbered.withColumn("position", F.col("_before") + F.col("_place")).drop(
        "_range", "_place", "_before"
    )


def units_in_order(units: DataFrame, skipped: DataFrame) -> DataFrame:
    """path, skipped, position: units and skipped files, each kind in the order people read paths in."""
    both = units.select("path", F.lit(False).alias("skipped")).unionByName(
        skipped.select("path", F.lit(True).alias("skipped"))
    )
    return with_positions(both, F.col("skipped"), P.in_locale_order(F.col("path")), F.col("path"))
