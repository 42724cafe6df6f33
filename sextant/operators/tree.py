"""The directory tree as a node table: roll-up, parents, depth, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths as P

NO_DRIVER = "no dominant driver"

LEADER_COLUMNS = ["priority", "confidence", "drivers"]


def _leader_order() -> Column:
    """Highest priority first; ties by path, compared directory by directory.

    An area takes its leader from its best child, so equal priorities are decided by the child's
    name at each level and not by the whole path text.
    """
    parts = F.transform(P.segments(F.col("path")), P.in_locale_order)
    return F.struct((-F.col("priority")).alias("lead"), parts.alias("parts"))


def _has_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def area_rollup(units: DataFrame) -> DataFrame:
    """One row per area, the root included: unit count and the hottest scored unit.

    Units first collapse into their own directory, and only directories are expanded to their
    ancestors, so the wide expansion works on one row per directory. Both steps combine on the
    map side; the root, which every row belongs to, receives one row per map task.
    """
    leader = F.struct(F.col("path").alias("hot"), *LEADER_COLUMNS)
    scored = F.when(~_has_error(), F.struct(_leader_order().alias("rank"), leader.alias("unit")))
    directories = (
        units.withColumn("directory", P.parent_of(F.col("path")))
        .groupBy("directory")
        .agg(
            F.count(F.lit(1)).alias("units"),
            F.min_by(scored, scored["rank"]).alias("best"),
        )
    )
    areas = P.prefixes(F.col("directory"))
    return (
        directories.select(
            F.explode(F.concat(F.array(F.lit("")), areas)).alias("path"), "units", "best"
        )
        .groupBy("path")
        .agg(
            F.sum("units").alias("units"),
            F.min_by("best", F.col("best.rank")).alias("best"),
        )
        .select(
            "path", "units",
            F.coalesce("best.unit.priority", F.lit(0.0)).alias("priority"),
            F.coalesce("best.unit.confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("best.unit.drivers", F.array().cast("array<string>")).alias("drivers"),
            F.col("best.unit.hot").alias("hot"),
            F.col("best").isNull().alias("error"),
        )
    )


def _listed(names: Column, empty: str) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(empty))


def unit_hint(drivers: Column, uncertain: Column, error: Column) -> Column:
    doubt = F.when(
        F.size(uncertain) > 0, F.concat(F.lit(" · uncertain: "), F.array_join(uncertain, ", "))
    ).otherwise(F.lit(""))
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(failed, F.concat(F.lit("unscored: "), error)).otherwise(
        F.concat(_listed(drivers, NO_DRIVER), doubt)
    )


def area_hint(path: Column, hot: Column, priority: Column, drivers: Column) -> Column:
    return F.when(hot.isNull(), F.lit("no scored units")).otherwise(
        F.concat(
            F.lit("hottest "), P.relative_to(path, hot),
            F.lit(" ("), F.format_string("%.1f", priority), F.lit(") via "),
            _listed(drivers, NO_DRIVER),
        )
    )


def node_table(units: DataFrame) -> DataFrame:
    """Areas and units as one flat table with depth and parent.

    Children are the rows whose ``parent`` is the node, so no list of children is stored.
    """
    areas = area_rollup(units).select(
        "path",
        F.when(F.col("path") == "", F.lit(".")).otherwise(P.base_name(F.col("path"))).alias("name"),
        F.lit("area").alias("kind"),
        "units", "priority", "confidence", "drivers", "hot", "error",
        area_hint(F.col("path"), F.col("hot"), F.col("priority"), F.col("drivers")).alias("hint"),
        F.array().cast("array<string>").alias("exports"),
    )
    exports = F.col("exports") if "exports" in units.columns else F.array().cast("array<string>")
    leaves = units.select(
        "path",
        P.base_name(F.col("path")).alias("name"),
        F.lit("unit").alias("kind"),
        F.lit(1).cast("bigint").alias("units"),
        "priority", "confidence", "drivers",
        F.col("path").alias("hot"),
        _has_error().alias("error"),
        unit_hint(F.col("drivers"), F.col("uncertain"), F.col("error")).alias("hint"),
        exports.alias("exports"),
    )
    both = areas.unionByName(leaves)
    return both.withColumns(
        {"depth": P.depth_of(F.col("path")), "parent": P.parent_of(F.col("path"))}
    )


def leading_units(units: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` leading units of every area (``area, position``), the root included.

    An area's leaders are among the leaders of its directories: units are cut per directory
    first, and only what is left is expanded to the ancestors. Either cut runs as a group limit
    ahead of its exchange, so an area with most of the units sends ``keep`` rows per map task.
    """

    def cut(rows: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(*by_priority())
        return rows.withColumn("position", F.row_number().over(order)).where(
            F.col("position") <= keep
        )

    own = cut(units.withColumn("directory", P.parent_of(F.col("path"))), "directory")
    spread = own.drop("directory", "position").withColumn(
        "area", F.explode(P.ancestors(F.col("path")))
    )
    return cut(spread, "area")


CHILD_SAMPLE = 10  # fixed value


def with_child_names(nodes: DataFrame) -> DataFrame:
    """Add ``child_names``: the leading children of every area, one more than is ever shown."""
    order = Window.partitionBy("parent").orderBy(*by_priority())
    sample = (
        nodes.where(F.col("parent").isNotNull())
        .select("parent", "name", "path", "priority")
        .withColumn("slot", F.row_number().over(order))
        .where(F.col("slot") <= CHILD_SAMPLE + 1)
        .groupBy(F.col("parent").alias("path"))
        .agg(F.array_sort(F.collect_list(F.struct("slot", "name"))).alias("listed"))
        .select("path", F.col("listed.name").alias("child_names"))
    )
    return nodes.join(sample, "path", "left").withColumn(
        "child_names", F.coalesce("child_names", F.array().cast("array<string>"))
    )


def areas_of(nodes: DataFrame) -> DataFrame:
    """All areas but the root."""
    return nodes.where((F.col("kind") == "area") & (F.col("path") != ""))


def find_node(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def children_of(nodes: DataFrame, path: str | None) -> DataFrame:
    """What a scope opens to: a unit to itself, an area to its children, nothing to the root's."""
    at = path or ""
    unit = (F.col("path") == at) & (F.col("kind") == "unit")
    return nodes.where(unit | (F.col("parent") == at))


def by_priority(path: str = "path") -> list[Column]:
    return [F.desc("priority"), F.asc(P.in_locale_order(F.col(path)))]
