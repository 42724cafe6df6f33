"""Evidence queries over the tables of a run.

Each tool exists for one argument (bounded result) and, where that makes sense, for every unit or
area at once as one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import paths as P
from sextant.functions.numeric import percent_label
from sextant.operators.packages import Links
from sextant.operators.tree import NO_DRIVER, areas_of, by_priority, leading_units
from sextant.session import cut_lineage

# List lengths.
MAX_CANDIDATES = 40
MAX_HOTSPOTS = 10
WORK_LIMIT = 10

UNIT_COLUMNS = ["path", "priority", "confidence", "drivers", "uncertain"]


def scored_units(run_units: DataFrame, area: str | None = None) -> DataFrame:
    """Units without an error inside an area; ``.`` and the empty text mean everything."""
    healthy = F.coalesce(F.col("error"), F.lit("")) == ""
    return run_units.where(healthy & P.in_scope(F.col("path"), area))


def units_in_scope(run_units: DataFrame, area: str | None = None) -> DataFrame:
    return run_units.where(P.in_scope(F.col("path"), area))


def hotspots(run_units: DataFrame, area: str | None = None, limit: int = MAX_HOTSPOTS) -> DataFrame:
    return (
        scored_units(run_units, area)
        .select("path", "priority", "drivers")
        .orderBy(*by_priority())
        .limit(limit)
    )


def work_list(run_units: DataFrame, area: str | None = None, limit: int = WORK_LIMIT) -> DataFrame:
    return (
        scored_units(run_units, area).select(*UNIT_COLUMNS).orderBy(*by_priority()).limit(limit)
    )


def top_of_areas(run_units: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The leading scored units of every area, the root written as ``.``."""
    kept = list(dict.fromkeys(["path", "priority", *columns]))
    return leading_units(scored_units(run_units).select(*kept), limit).withColumn(
        "area", F.when(F.col("area") == "", ".").otherwise(F.col("area"))
    )


def drivers_text(drivers: Column) -> Column:
    return F.when(F.size(drivers) > 0, F.array_join(drivers, ", ")).otherwise(F.lit(NO_DRIVER))


def catalog_units(run_units: DataFrame, area: str | None = None) -> DataFrame:
    text = F.concat(
        F.lit("priority "), F.format_string("%.1f", "priority"), F.lit(", "),
        drivers_text(F.col("drivers")),
    )
    return (
        scored_units(run_units, area)
        .orderBy(*by_priority())
        .limit(MAX_CANDIDATES)
        .select(F.col("path").alias("value"), text.alias("description"))
    )


def catalog_areas(nodes: DataFrame, area: str | None = None) -> DataFrame:
    text = F.concat(
        F.lit("area, "), F.col("units").cast("string"), F.lit(" units, priority "),
        F.format_string("%.1f", "priority"),
    )
    return (
        areas_of(nodes)
        .where(P.in_scope(F.col("path"), area))
        .orderBy(*by_priority())
        .limit(MAX_CANDIDATES)
        .select(F.col("path").alias("value"), text.alias("description"))
    )


def unit_at(run_units: DataFrame, path: str) -> DataFrame:
    return run_units.where(F.col("path") == path)


def _into(edges: DataFrame | Links, path: str) -> DataFrame:
    return edges.into(path) if isinstance(edges, Links) else edges.where(F.col("dst") == path)


def list_dependents(edges: DataFrame | Links, path: str) -> DataFrame:
    return _into(edges, path).select(F.col("src").alias("dependent"))


def coupling_rows(run_units: DataFrame) -> DataFrame:
    """The stored couplings of every unit, one row each."""
    return run_units.select("path", F.posexplode("history.couplings").alias("at", "c")).select(
        "path",
        (F.col("at") + 1).alias("position"),
        F.col("c.path").alias("other"),
        F.col("c.co_changes").alias("co_changes"),
        F.col("c.strength").alias("strength"),
        percent_label(F.col("c.strength")).alias("label"),
    )


def git_history(run_units: DataFrame) -> DataFrame:
    h = "history."
    return run_units.where(F.col("history").isNotNull()).select(
        "path", h + "commits", h + "recent_commits", h + "bug_fix_commits", h + "revert_commits",
        h + "authors", h + "recent_authors",
        percent_label(F.col(h + "primary_author_share")).alias("top_author"),
        h + "last_modified", h + "first_seen", h + "sum_coupling",
    )


def impact_rows(edges: DataFrame, couplings: DataFrame, run_units: DataFrame) -> DataFrame:
    """What a change to each unit disturbs: importers, then co-changing files.

    ``edges`` and ``couplings`` may be cut to one unit. The two sources are merged per pair of
    files, so a hub's rows spread over all partitions. Importers that are no run units (tests)
    stay, with priority 0.
    """
    importers = edges.select(
        F.col("dst").alias("path"), F.col("src").alias("affected"),
        F.lit(0).alias("rank"), F.lit(0.0).alias("strength"),
    )
    partners = couplings.select(
        "path", F.col("other").alias("affected"),
        F.lit(1).alias("rank"), "strength",
    )
    merged = (
        importers.join(run_units.select("path"), "path", "left_semi")
        .unionByName(partners)
        .groupBy("path", "affected")
        .agg(F.min("rank").alias("rank"), F.max("strength").alias("strength"))
    )
    priorities = run_units.select(F.col("path").alias("affected"), "priority")
    return merged.join(priorities, "affected", "left").select(
        "path", "affected",
        F.coalesce("priority", F.lit(0.0)).alias("priority"),
        F.when(F.col("rank") == 0, F.lit("imports it"))
        .otherwise(F.concat(F.lit("co-changes "), percent_label(F.col("strength"))))
        .alias("relation"),
    )


def change_impact(edges: DataFrame | Links, run_units: DataFrame, path: str) -> DataFrame:
    one = unit_at(run_units, path)
    return impact_rows(
        _into(edges, path), coupling_rows(one), run_units
    ).drop("path").orderBy(
        F.desc("priority"), F.asc(P.in_locale_order(F.col("affected")))
    )


def work_members(run_units: DataFrame) -> DataFrame:
    """The work list of every area with each member's coupled files."""
    slim = run_units.select(
        "path", "priority", "error",
        F.coalesce("history.couplings.path", F.array().cast("array<string>")).alias("coupled"),
    )
    return top_of_areas(slim, ["coupled"], WORK_LIMIT)


def lane_conflicts(members: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """Pairs of an area's work list that must not run at once (``first`` ranks higher).

    Lists have at most ten members, so an area has at most 45 pairs. Pairs conflict when one
    imports the other, one is coupled to the other, or both are coupled to the same file.
    """
    def side(name: str) -> DataFrame:
        return members.select(
            "area", F.col("position").alias(f"{name}_at"), F.col("path").alias(name),
            F.col("coupled").alias(f"{name}_coupled"),
        )

    pairs = side("first").join(side("second"), "area").where(
        F.col("first_at") < F.col("second_at")
    )
    listed = pairs.select(F.col("first").alias("src"), F.col("second").alias("dst")).distinct()
    either = listed.unionByName(listed.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # The pairs of all work lists are few next to the edges: stored, they are planned by their size.
    known = (
        edges.among(either) if isinstance(edges, Links)
        else edges.join(cut_lineage(either), ["src", "dst"], "left_semi")
    )
    imported = known.select(
        F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"),
        F.lit(True).alias("imported"),
    ).distinct()
    coupled = (
        F.array_contains("first_coupled", F.col("second"))
        | F.array_contains("second_coupled", F.col("first"))
        | F.arrays_overlap("first_coupled", "second_coupled")
    )
    return (
        pairs.withColumns(
            {"low": F.least("first", "second"), "high": F.greatest("first", "second")}
        )
        .join(imported, ["low", "high"], "left")
        .where(coupled | F.coalesce("imported", F.lit(False)))
        .select("area", "first_at", "second_at", "first", "second")
    )


def safe_lanes(members: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """First-fit lanes of every area's work list.

    A member's conflicts with earlier members are one bit mask; a fold over the at most ten
    members of the list keeps one mask per lane and puts each member into the first lane it
    does not collide with.
    """
    bits = {n: 1 << (n - 1) for n in range(1, WORK_LIMIT + 1)}
    one_bit = reduce(
        lambda acc, n: F.when(F.col("first_at") == n, F.lit(bits[n])).otherwise(acc),
        bits,
        F.lit(0),
    )
    masks = lane_conflicts(members, edges).groupBy("area", "second_at").agg(
        F.sum(one_bit).cast("int").alias("mask")
    )
    lists = (
        members.join(
            masks.withColumnRenamed("second_at", "position"), ["area", "position"], "left"
        )
        .groupBy("area")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "position", "path", "priority",
                        F.coalesce("mask", F.lit(0)).alias("mask"),
                    )
                )
            ).alias("members")
        )
    )

    def place(lanes: Column, member: Column) -> Column:
        own = F.pow(F.lit(2), member["position"] - 1).cast("int")
        free = F.array_position(
            F.transform(lanes, lambda lane: lane.bitwiseAND(member["mask"]) == 0), F.lit(True)
        )
        return F.when(free == 0, F.concat(lanes, F.array(own))).otherwise(
            F.transform(
                lanes,
                lambda lane, at: F.when(at == free - 1, lane.bitwiseOR(own)).otherwise(lane),
            )
        )

    empty = F.array().cast("array<int>")
    placed = lists.withColumn("lanes", F.aggregate("members", empty, place))
    return placed.select("area", "lanes", F.explode("members").alias("m")).select(
        "area",
        F.array_position(
            F.transform(
                "lanes",
                lambda lane: lane.bitwiseAND(
                    F.pow(F.lit(2), F.col("m.position") - 1).cast("int")
                )
                != 0,
            ),
            F.lit(True),
        ).alias("lane"),
        F.col("m.position").alias("position"),
        F.col("m.path").alias("path"),
        F.col("m.priority").alias("priority"),
    )
