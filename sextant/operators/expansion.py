"""Candidates of every area at once.

Strategies go in order. A node that an earlier strategy has picked is no candidate of a later one and
uses none of its cap, so each strategy is an anti-join with what is picked so far and a group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.search import STRATEGIES, SearchOptions, neighbourhood, of_anchors

RELATED = STRATEGIES[2:]


def expand_all(
    nodes: DataFrame, relations: DataFrame, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """area, path, strategy, slot: what each area offers by descending and through its hottest unit.

    A hub's relations are limited before they meet areas: earlier picks can take away no more than
    their own caps, so that many more than a cap are enough to fill it.
    """
    enough = options.max_descend + len(RELATED) * options.max_related
    tops = Window.partitionBy("path", "strategy").orderBy("place", "target")
    anchors, related = of_anchors(nodes, relations)
    nearest = (
        related.withColumn("at", F.row_number().over(tops))
        .where(F.col("at") <= enough)
        .select(F.col("path").alias("hot"), "strategy", F.col("target").alias("path"), "place")
    )
    offered = anchors.join(nearest, "hot").select("area", "path", "strategy", "place")
    picked = neighbourhood(nodes, options).select(
        "area", "path", F.lit("descend").alias("strategy"), "slot"
    )
    order = Window.partitionBy("area").orderBy("place", "path")
    for strategy in RELATED:
        fresh = offered.where(F.col("strategy") == strategy).join(
            picked.select("area", "path"), ["area", "path"], "left_anti"
        )
        chosen = fresh.withColumn("slot", F.row_number().over(order)).where(
            F.col("slot") <= options.max_related
        )
        picked = picked.unionByName(chosen.select("area", "path", "strategy", "slot"))
    return picked
