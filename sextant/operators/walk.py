"""Best-first search of many objectives at once.

The state of all walks is a few tables keyed by objective: the frontier, what was visited, and how
far each walk is. A step pops from every frontier what lies ahead of its first area and expands that
area, for all objectives together; each step is a stored table. There are as many steps as the
longest walk has, whatever the number of objectives.

What an area or its hottest unit offers is cut once to what a walk can use up: its caps and what it
may have visited by then, so no step reads a hub's or a large area's whole list. What is left is a
short list for each area, and a step takes what is new of an objective's lists in one row; only what it
takes becomes rows. Words are matched by the terms that meet anything of the map at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths as P
from sextant.functions.numeric import clamp01, percent_label
from sextant.functions.text import identifier_tokens, match_count, symbol_terms
from sextant.operators.search import RETRIEVAL_FLOOR, STRATEGIES, SearchMap, SearchOptions, of_anchors
from sextant.operators.symbols import best_symbols, term_tokens, with_terms
from sextant.operators.tree import by_priority
from sextant.session import cut_lineage, join_in_blocks

TRAIL = "array<struct<from:string,chosen:string,confidence:double,strategy:string,relation:string>>"
UNIT = ["priority", "confidence", "drivers"]


def lexical_odds(offered: DataFrame) -> DataFrame:
    """``offered`` (objective, terms, met, path, exports) with the probability of each candidate and
    the confidence of each choice: the words that match, shared out among an objective's candidates."""
    hits = match_count(F.col("met"), symbol_terms(F.col("path"), F.col("exports"))).cast("double")
    choice = Window.partitionBy("objective")
    total = F.sum("hits").over(choice) + F.lit(0.05) * F.count(F.lit(1)).over(choice)
    return offered.withColumn("hits", hits).withColumns(
        {
            "probability": (F.lit(0.05) + F.col("hits")) / total,
            "sure": F.when(F.max("hits").over(choice) > 0, 0.9).otherwise(0.3),
        }
    ).drop("hits")


def lexical_relevance(listed: DataFrame) -> DataFrame:
    """``listed`` (objective, terms, met, path) with relevance and its confidence."""
    terms = F.size("terms")
    none = F.array().cast("array<string>")
    share = match_count(F.col("met"), symbol_terms(F.col("path"), none)) / terms
    return listed.withColumns(
        {
            "relevance": F.when(terms > 0, F.least(share, F.lit(1.0))).otherwise(0.0),
            "relevance_confidence": F.lit(0.8),
        }
    )


def with_met_terms(objectives: DataFrame, nodes: DataFrame) -> DataFrame:
    """``objectives`` with ``terms`` and ``met``, those of them that match any node; stored."""
    asked = cut_lineage(with_terms(objectives).withColumn("row", F.monotonically_increasing_id()))
    path = F.col("path")
    tokens = F.coalesce(symbol_terms(path, F.col("exports")), identifier_tokens(path))
    vocabulary = cut_lineage(nodes.select(F.explode(tokens).alias("token")).distinct())
    known = cut_lineage(term_tokens(asked, vocabulary).select("term").distinct())
    met = (
        asked.select("row", F.explode("terms").alias("term")).join(known, "term")
        .groupBy("row").agg(F.sort_array(F.collect_list("term")).alias("met"))
    )
    none = F.array().cast("array<string>")
    return cut_lineage(
        asked.join(met, "row", "left").drop("row").withColumn("met", F.coalesce("met", none))
    )


@dataclass
class Offers:
    """What there is to choose from: ``areas`` (area, and a list for each strategy but symbols) and
    ``symbols`` of an objective (objective, symbols). Lists have structs of path and relation, in
    the order of their strategy, each path once."""

    areas: DataFrame
    symbols: DataFrame


OFFERED = "array<struct<path:string,relation:string>>"


def first_of(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("slot", F.row_number().over(window)).where(F.col("slot") <= keep)


def in_lists(rows: DataFrame, key: str) -> DataFrame:
    """key and a list for each strategy of rows (key, strategy, slot, path, relation): what it offers
    twice (a child within reach) counts where it comes first."""
    first = F.min_by("relation", "slot").alias("relation")
    once = rows.groupBy(key, "strategy", "path").agg(F.min("slot").alias("slot"), first)

    def listed(strategy: str) -> Column:
        row = F.struct("slot", "path", "relation")
        of_strategy = F.array_sort(F.collect_list(F.when(F.col("strategy") == strategy, row)))
        return F.transform(
            of_strategy, lambda r: F.struct(r["path"].alias("path"), r["relation"].alias("relation"))
        ).cast(OFFERED).alias(strategy)

    return once.groupBy(key).agg(*(listed(strategy) for strategy in STRATEGIES))


def offers(map_: SearchMap, objectives: DataFrame, options: SearchOptions) -> Offers:
    visited = (options.budget + 1) * (options.branch + 1)
    picked = options.max_descend + options.max_symbols + 3 * options.max_related
    enough = visited + picked
    nodes = map_.nodes
    reach = F.slice(F.reverse(P.ancestors(F.col("path"))), 1, options.lookahead)
    below = nodes.where(F.col("path") != "").select(
        "path", "kind", "priority", F.posexplode(reach).alias("up", "area")
    )
    children = below.where("up = 0").groupBy("area").agg(F.count(F.lit(1)).alias("children"))
    # Children come first, then, below areas with few of them, all within reach.
    tiers = below.withColumn("tier", F.when(F.col("up") == 0, 0).otherwise(1))
    cut = first_of(tiers, ["area", "tier"], by_priority(), enough).drop("slot")
    kept = cut.join(children, "area").where(
        (F.col("tier") == 0) | (F.col("children") < options.target)
    )
    near = first_of(kept, ["area"], [F.col("tier"), *by_priority()], enough)
    relation = F.when(
        F.col("tier") == 0,
        F.when(F.col("kind") == "unit", "file in this area").otherwise("sub-area"),
    ).otherwise(F.concat((F.col("up") + 1).cast("string"), F.lit(" levels down")))
    anchors, of_hottest = of_anchors(nodes, map_.relations)
    related = first_of(of_hottest, ["path", "strategy"], [F.col("place"), F.col("target")], enough).select(
        F.col("path").alias("hot"), "strategy", F.col("target").alias("path"), "slot", "strength"
    )
    known = related.join(nodes.select("path").distinct(), "path", "left_semi")
    label = P.relative_to(F.col("area"), F.col("hot"))
    texts = {
        "imports": F.concat(F.lit("imported by "), label),
        "dependents": F.concat(F.lit("imports "), label),
        "coupled": F.concat(
            F.lit("changes together with "), label, F.lit(" ("), percent_label(F.col("strength")), F.lit(")")
        ),
    }
    text = F.lit(None).cast("string")
    for strategy, value in texts.items():
        text = F.when(F.col("strategy") == strategy, value).otherwise(text)
    columns = ["area", "strategy", "slot", "path", "relation"]
    of_area = near.withColumn("strategy", F.lit("descend")).withColumn("relation", relation)
    of_hot = cut_lineage(known).join(anchors.distinct(), "hot").withColumn("relation", text)
    lists = in_lists(of_area.select(*columns).unionByName(of_hot.select(*columns)), "area")
    # An area that offers nothing has a row as well, at the root symbols may be all there is.
    areas = nodes.where("kind = 'area'").select(F.col("path").alias("area")).distinct()
    symbols = best_symbols(objectives, nodes, picked + 1).withColumns(
        {"strategy": F.lit("symbols"), "relation": F.concat(F.lit('matches "'), "label", F.lit('"'))}
    )
    return Offers(
        cut_lineage(areas.join(lists.drop("symbols"), "area", "left")),
        cut_lineage(in_lists(symbols, "objective").select("objective", "symbols")),
    )


def candidates(
    popped: DataFrame, visited: DataFrame, found: Offers, root: str, options: SearchOptions
) -> DataFrame:
    """objective, area, path, strategy, relation of what each popped area (objective, area) offers.
    Strategies go in order; what is visited or picked before uses up no cap."""
    seen = visited.groupBy("objective").agg(F.collect_set("path").alias("seen"))
    symbols = found.symbols.withColumn("area", F.lit(root))
    asked = (
        popped.select("objective", "area").distinct().join(seen, "objective", "left")
        .join(symbols, ["objective", "area"], "left")
    )
    caps = dict.fromkeys(STRATEGIES, options.max_related) | {
        "descend": options.max_descend, "symbols": options.max_symbols
    }
    none = F.array().cast("array<string>")
    # Many walks may be at one area: they meet its lists in blocks, not in one task.
    rows = join_in_blocks(cut_lineage(asked), found.areas, "area", block=100).withColumn(
        "seen", F.array_union(F.coalesce("seen", none), F.array("area"))
    )
    for strategy in STRATEGIES:
        listed = F.col(strategy)
        taken = F.slice(F.array_except(listed["path"], F.col("seen")), 1, caps[strategy])
        rows = rows.withColumn("taken", F.coalesce(taken, none)).withColumns(
            {
                "seen": F.array_union("seen", "taken"),
                strategy: F.coalesce(
                    F.filter(listed, lambda offer: F.array_contains("taken", offer["path"])),
                    F.array().cast(OFFERED),
                ),
            }
        )

    def picked(strategy: str) -> Column:
        return F.transform(strategy, lambda o: F.struct("area", F.lit(strategy), o["path"], o["relation"]))

    picks = F.explode(F.concat(*map(picked, STRATEGIES))).alias("pick")
    pick = "struct<area:string,strategy:string,path:string,relation:string>"
    return rows.select("objective", picks).select("objective", F.col("pick").cast(pick).alias("pick")).select(
        "objective", "pick.*"
    )


@dataclass
class Walks:
    """``found``: objective, path, retrieval, trail of units that surfaced. ``states``: objective,
    steps, stop (``budget`` or ``exhausted``)."""

    found: DataFrame
    states: DataFrame


def walk_all(
    map_: SearchMap, objectives: DataFrame, options: SearchOptions = SearchOptions(), odds=lexical_odds
) -> Walks:
    """Walk the map for every objective (objective, intent). ``odds`` adds ``probability`` and
    ``sure`` (the confidence of the choice) to the candidates of all objectives of a step."""
    nodes = map_.nodes
    asked = objectives if "met" in objectives.columns else with_met_terms(objectives, nodes)
    offered = offers(map_, asked, options)
    start = nodes.where(F.col("path") == map_.root).select("path", "kind", "hot")
    root = cut_lineage(start).first()
    front = asked.select(
        "objective", F.lit(map_.root).alias("path"), F.lit("area" if root is None else root["kind"]).alias("kind"),
        F.lit(None if root is None else root["hot"]).cast("string").alias("hot"),
        F.lit(1.0).alias("score"), F.lit(0).alias("pushed"), F.array().cast(TRAIL).alias("trail"),
    )
    front = cut_lineage(front if root is not None else front.where(F.lit(False)))
    states = asked.select("objective", F.lit(0).alias("steps"), F.lit("exhausted").alias("stop"))
    visited = cut_lineage(front.select("objective", "path").where(F.lit(False)))
    parts: list[DataFrame] = []
    step = 0
    while not front.isEmpty():
        step += 1
        order = Window.partitionBy("objective").orderBy(
            F.desc("score"), F.asc(P.in_locale_order(F.col("path"))), F.asc("pushed")
        )
        first_area = F.min(F.when(F.col("kind") == "area", F.col("at"))).over(Window.partitionBy("objective"))
        ranked = cut_lineage(
            front.withColumn("at", F.row_number().over(order)).withColumn("area_at", first_area)
        )
        ahead = ranked.where("kind = 'unit' AND (area_at IS NULL OR at < area_at)")
        parts.append(ahead.select("objective", "path", F.col("score").alias("retrieval"), "trail"))
        heads = ranked.where("at = area_at").join(states, "objective")
        popped = cut_lineage(
            heads.where(F.col("steps") < options.budget).select(
                "objective", F.col("path").alias("area"), "hot", F.col("trail").alias("so_far"))
        )
        over = heads.where(F.col("steps") >= options.budget).select("objective", F.lit(True).alias("over"))
        ended = states.join(over, "objective", "left").select(
            "objective", "steps", F.when(F.col("over"), "budget").otherwise(F.col("stop")).alias("stop")
        )
        if popped.isEmpty():
            states = cut_lineage(ended)
            break
        visited = cut_lineage(
            visited.unionByName(ahead.select("objective", "path")).unionByName(
                popped.select("objective", F.col("area").alias("path")))
        )
        offered_now = candidates(popped, visited, offered, map_.root, options)
        facts = nodes.select("path", "kind", "hot", "exports")
        words = asked.select("objective", "terms", "met")
        judged = cut_lineage(
            odds(offered_now.join(facts, "path").join(words, "objective")).drop("terms", "met", "exports")
        )
        chosen = first_of(
            judged.where((F.col("probability") > 0) & (F.col("sure") >= options.min_confidence)),
            ["objective"], [F.desc("probability"), F.asc(P.in_locale_order(F.col("path")))], options.branch,
        )
        trail = F.struct(
            F.when(F.col("area") == "", ".").otherwise(F.col("area")).alias("from"),
            F.col("path").alias("chosen"), F.col("sure").alias("confidence"), "strategy", "relation",
        )
        pushed = chosen.join(popped.select("objective", "so_far"), "objective").select(
            "objective", "path", "kind", "hot",
            F.greatest("probability", F.lit(RETRIEVAL_FLOOR)).alias("score"), F.lit(step).alias("pushed"),
            F.concat("so_far", F.array(trail)).alias("trail"),
        )
        moved = judged.select("objective").distinct().withColumn("moved", F.lit(1))
        states = cut_lineage(ended.join(moved, "objective", "left").select(
            "objective", (F.col("steps") + F.coalesce("moved", F.lit(0))).alias("steps"), "stop"))
        rest = ranked.where("at > area_at").join(popped.select("objective"), "objective", "left_semi")
        both = rest.select(*front.columns).unionByName(pushed)
        best = Window.partitionBy("objective", "path").orderBy(F.desc("score"), F.asc("pushed"))
        front = cut_lineage(
            both.withColumn("best", F.row_number().over(best)).where("best = 1").drop("best")
        )
    found = parts[0] if parts else front.select("objective", "path", F.col("score").alias("retrieval"), "trail")
    for part in parts[1:]:
        found = found.unionByName(part)
    return Walks(cut_lineage(found), states)


def shortlists(map_: SearchMap, walks: Walks, options: SearchOptions) -> DataFrame:
    """objective, path, priority, confidence, drivers, retrieval, trail: the units an objective is
    scored on. Hits come first; what room is left is filled with leaders of areas, hottest area
    first, each unit once.

    Fewer than a shortlist of hits leave room, so twice its size of leaders is enough for all.
    """
    size = options.shortlist_size
    units = map_.nodes.where(F.col("kind") == "unit").select("path", *UNIT)
    hits = first_of(
        walks.found.join(units, "path"), ["objective"],
        [F.desc("retrieval"), F.desc("priority"), F.asc(P.in_locale_order(F.col("path")))], size,
    )
    hits = cut_lineage(hits)
    inside = F.lit(True) if map_.root == "" else (
        (F.col("area") == map_.root) | P.is_below(F.col("area"), map_.root)
    )
    visit = F.struct(
        (-F.col("area_priority")).alias("lead"), P.in_locale_order(F.col("area")).alias("area"), "position"
    )
    leaders = (
        map_.leaders.where(inside).groupBy("path", *UNIT).agg(F.min(visit).alias("visit"))
        .orderBy("visit").limit(2 * size)
    )
    listed = F.array_sort(F.collect_list(F.struct("visit", "path", *UNIT)))
    leading = cut_lineage(leaders).agg(listed.alias("listed")).scalar()
    taken = hits.groupBy("objective").agg(F.collect_set("path").alias("taken"))
    # Each of the few bytes of a walk's state becomes a shortlist: dealt out by number, not by size.
    partitions = int(map_.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    free = walks.states.select("objective").repartition(partitions, "objective").join(
        taken, "objective", "left"
    ).withColumn("leading", leading)
    none = F.array().cast("array<string>")
    unseen = F.filter("leading", lambda u: ~F.array_contains(F.coalesce("taken", none), u["path"]))
    room = F.greatest(F.lit(size) - F.size(F.coalesce("taken", none)), F.lit(0))
    filled = free.select("objective", F.explode(F.slice(unseen, F.lit(1), room)).alias("u")).select(
        "objective", "u.path", *(f"u.{name}" for name in UNIT), F.lit(0.0).alias("retrieval"),
        F.array().cast(TRAIL).alias("trail"),
    )
    return hits.select(*filled.columns).unionByName(filled)


def search_all(
    map_: SearchMap, objectives: DataFrame, options: SearchOptions = SearchOptions(),
    odds=lexical_odds, relevance=lexical_relevance,
) -> DataFrame:
    """objective, position, path, relevance, relevance_confidence, priority, drivers, confidence,
    trail: the ranked opportunities of every objective."""
    asked = with_met_terms(objectives, map_.nodes)
    walks = walk_all(map_, asked, options, odds)
    listed = shortlists(map_, walks, options).join(asked.select("objective", "terms", "met"), "objective")
    judged = relevance(listed).withColumns(
        {
            "relevance": F.coalesce("relevance", clamp01(F.col("retrieval"))),
            "relevance_confidence": F.coalesce("relevance_confidence", F.lit(0.0)),
        }
    )
    order = [F.desc("relevance"), F.desc("priority"), F.asc(P.in_locale_order(F.col("path")))]
    top = first_of(judged.where("relevance > 0"), ["objective"], order, options.limit)
    return top.select(
        "objective", F.col("slot").alias("position"), "path", "relevance", "relevance_confidence",
        "priority", "drivers", "confidence", "trail",
    )
