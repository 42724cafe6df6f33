"""The import graph with packages kept whole.

An import of a package stands for an import of each of its files. Written out, a package of n files
with m importers is n * m edges. Here it stays n members and m users, and what is asked of the graph
(fan-in and fan-out, fingerprints of dependents, what a change affects) is computed for a package
once and handed to its members, less what a member that uses its own package adds to itself.

Aggregates of a package are stored before they are joined with its members or users, so that a
package with a third of all of them is split at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.digest import LANES, lane_values, lanes_digest
from sextant.session import cut_lineage, join_in_lists

LANE_NAMES = [f"lane_{lane}" for lane in range(LANES)]
LANE = "decimal(38,0)"


@dataclass
class Links:
    """``direct`` (src, dst): imports of files, distinct, none of a file by itself. ``uses`` (src,
    package): imports of packages, distinct. ``members`` (package, path): their files; a file is in
    one package at most, and no file of a package is in ``direct`` as ``dst``."""

    direct: DataFrame
    uses: DataFrame
    members: DataFrame

    def stored(self) -> Links:
        return Links(*(cut_lineage(part) for part in (self.direct, self.uses, self.members)))

    def named(self) -> DataFrame:
        """src, dst, kind: every import once, a package by its name."""
        files = self.direct.select("src", "dst", F.lit("file").alias("kind"))
        return files.unionByName(
            self.uses.select("src", F.col("package").alias("dst"), F.lit("package").alias("kind"))
        )

    def written_out(self) -> DataFrame:
        """All edges src, dst: grows with members times users, a user meets members as lists."""
        uses, members = cut_lineage(self.uses), cut_lineage(self.members)
        through = join_in_lists(uses, members, "package").select("src", F.col("path").alias("dst"))
        return self.direct.unionByName(through.where("src != dst"))

    def into(self, path: str) -> DataFrame:
        """Edges into one file."""
        own = self.members.where(F.col("path") == path)
        through = self.uses.join(own, "package").select("src", F.col("path").alias("dst"))
        return self.direct.where(F.col("dst") == path).unionByName(through.where("src != dst"))

    def among(self, pairs: DataFrame) -> DataFrame:
        """The pairs src, dst that are edges."""
        asked = pairs.select("src", "dst").distinct()
        of_package = asked.join(self.members.withColumnRenamed("path", "dst"), "dst")
        through = of_package.join(self.uses, ["src", "package"], "left_semi").select("src", "dst")
        return asked.join(self.direct, ["src", "dst"], "left_semi").unionByName(
            through.where("src != dst")
        )


def own_uses(links: Links) -> DataFrame:
    """path, package: members that use their own package."""
    users = links.uses.withColumnRenamed("src", "path")
    return links.members.join(users, ["path", "package"], "left_semi")


def _contribution(path: str, fan_in: Column, fan_out: Column, lanes: list[Column] | None) -> list[Column]:
    zero = [F.lit(0).cast(LANE)] * LANES
    named = [c.cast(LANE).alias(n) for c, n in zip(lanes or zero, LANE_NAMES, strict=True)]
    return [
        F.col(path).alias("path"), fan_in.cast("long").alias("fan_in"),
        fan_out.cast("long").alias("fan_out"), *named,
    ]


def graph_sums(links: Links) -> DataFrame:
    """path, fan_in, fan_out and the lane sums of a file's dependents, for files that have any."""
    one, none = F.lit(1), F.lit(0)
    ends = links.direct.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("path"), F.col("src").alias("other")),
                F.struct(F.col("src").alias("path"), F.lit(None).cast("string").alias("other")),
            )
        ).alias("end")
    ).select("end.*")
    into = F.col("other").isNotNull()
    direct = ends.select(
        *_contribution(
            "path", F.when(into, one).otherwise(none), F.when(into, none).otherwise(one),
            [F.coalesce(v, F.lit(0)) for v in lane_values(F.col("other"))],
        )
    )
    used = cut_lineage(
        links.uses.groupBy("package").agg(
            F.count(F.lit(1)).alias("users"),
            *[F.sum(v).alias(n) for v, n in zip(lane_values(F.col("src")), LANE_NAMES, strict=True)],
        )
    )
    sizes = cut_lineage(links.members.groupBy("package").agg(F.count(F.lit(1)).alias("files")))
    through = links.members.join(used, "package").select(
        *_contribution("path", F.col("users"), none, [F.col(n) for n in LANE_NAMES])
    )
    out = links.uses.join(sizes, "package").select(*_contribution("src", none, F.col("files"), None))
    itself = own_uses(links).select(
        *_contribution("path", -one, -one, [-v for v in lane_values(F.col("path"))])
    )
    parts = direct.unionByName(through).unionByName(out).unionByName(itself)
    return parts.groupBy("path").agg(
        *[F.sum(n).alias(n) for n in ("fan_in", "fan_out", *LANE_NAMES)]
    )


def _of_units(units: DataFrame, links: Links) -> DataFrame:
    return units.select("path").join(graph_sums(links), "path", "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in ("fan_in", "fan_out")}
    )


def fan_in_out(units: DataFrame, links: Links) -> DataFrame:
    """Every unit with its fan-in and fan-out, zeros included."""
    return _of_units(units, links).select("path", "fan_in", "fan_out")


def graph_fingerprints(units: DataFrame, links: Links) -> DataFrame:
    """Digest of fan-in, fan-out and the set of dependents of every unit."""
    return _of_units(units, links).select(
        "path", lanes_digest(F.col("fan_in"), 16, F.col("fan_out")).alias("graph_fingerprint")
    )


def impact_summary(links: Links, priorities: DataFrame) -> DataFrame:
    """path, affected, top_affected, top_priority of every file that others import: how many a
    change affects, and the one of them with the highest priority, the first by path on ties.

    A package's two best users are enough for all of its members: one of them may be the member.
    """
    order = F.struct((-F.col("priority")).alias("lead"), F.col("src").alias("src"))
    known = priorities.select(F.col("path").alias("src"), "priority")
    direct = (
        links.direct.join(known, "src", "left").na.fill(0.0, ["priority"])
        .groupBy(F.col("dst").alias("path"))
        .agg(F.count(F.lit(1)).alias("affected"), F.min(order).alias("best"))
    )
    users = cut_lineage(links.uses.join(known, "src", "left").na.fill(0.0, ["priority"]))
    place = Window.partitionBy("package").orderBy(F.desc("priority"), "src")
    two = (
        users.withColumn("at", F.row_number().over(place)).where("at <= 2")
        .groupBy("package").agg(F.array_sort(F.collect_list(order)).alias("first"))
    )
    counted = users.groupBy("package").agg(F.count(F.lit(1)).alias("users"))
    of_package = cut_lineage(counted.join(two, "package"))
    itself = own_uses(links).select("path", F.lit(1).alias("own"))
    through = links.members.join(of_package, "package").join(itself, "path", "left").select(
        "path", (F.col("users") - F.coalesce("own", F.lit(0))).alias("affected"),
        F.try_element_at(
            F.filter("first", lambda user: user["src"] != F.col("path")), F.lit(1)
        ).alias("best"),
    )
    return (
        direct.unionByName(through).groupBy("path")
        .agg(F.sum("affected").alias("affected"), F.min("best").alias("best"))
        .where("affected > 0")
        .select(
            "path", "affected", F.col("best.src").alias("top_affected"),
            (-F.col("best.lead")).alias("top_priority"),
        )
    )


def nearest_edges(links: Links, limit: int) -> tuple[DataFrame, DataFrame]:
    """Edges src, dst cut to the first ``limit`` by path: of each file's imports, and of each file's
    dependents. A package is cut before it meets its users or members, so neither grows with both."""

    def first(rows: DataFrame, key: str, by: str, keep: int) -> DataFrame:
        order = Window.partitionBy(key).orderBy(by)
        return rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep).drop("at")

    files = cut_lineage(first(links.members, "package", "path", limit + 1))
    users = cut_lineage(first(links.uses, "package", "src", limit + 1))
    imports = links.uses.join(files, "package").select("src", F.col("path").alias("dst"))
    dependents = links.members.join(users, "package").select("src", F.col("path").alias("dst"))
    return (
        first(links.direct.unionByName(imports.where("src != dst")), "src", "dst", limit),
        first(links.direct.unionByName(dependents.where("src != dst")), "dst", "src", limit),
    )


def review_context(links: Links, sample: int) -> DataFrame:
    """What a review shows of the graph: what a file's own statements import, packages by name, and
    its first ``sample`` dependents."""
    imports = links.named().groupBy(F.col("src").alias("path")).agg(
        F.array_sort(F.collect_list("dst")).alias("imports")
    )
    _, dependents = nearest_edges(links, sample)
    listed = dependents.groupBy(F.col("dst").alias("path")).agg(
        F.array_sort(F.collect_list("src")).alias("dependents_sample")
    )
    return imports.join(listed, "path", "full")
