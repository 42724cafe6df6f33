"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import stored


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after joining the components that ``links`` (a, b) touch.

    Works on components, not nodes: each takes the smallest label among its neighbours, then the
    label of that label, until nothing changes. A star, the common shape here, takes two rounds. The
    smallest neighbour is a combined aggregate, so a hub costs a row per task. Every round is a
    stored table, so a lost executor never reaches back to earlier rounds.
    """
    ends = links
    for end in ("a", "b"):
        ends = ends.join(
            labels.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), end
        )
    one = ends.where("comp_a != comp_b").select(
        F.col("comp_a").alias("x"), F.col("comp_b").alias("y")
    )
    both = stored(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state = stored(both.select(F.col("x").alias("comp")).distinct().withColumn("root", F.col("comp")))
    while True:
        heard = (
            both.join(state.withColumnRenamed("comp", "y"), "y")
            .groupBy("x")
            .agg(F.min("root").alias("heard"))
            .withColumnRenamed("x", "comp")
        )
        lower = state.join(heard, "comp", "left").select(
            "comp",
            F.col("root").alias("was"),
            F.least("root", F.coalesce("heard", "root")).alias("root"),
        )
        lower = stored(lower)
        jumped = stored(
            lower.join(
                lower.select(F.col("comp").alias("root"), F.col("root").alias("next")),
                "root", "left",
            ).select("comp", "was", F.coalesce("next", "root").alias("root"))
        )
        state = jumped.select("comp", "root")
        if jumped.where("root != was").isEmpty():
            break
    return stored(
        labels.join(state, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    )
