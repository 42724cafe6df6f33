"""Registered queries: every operator over the bound tables, with its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import digest, text
from sextant.functions import paths as P
from sextant.functions.lexer import DECISIONS, decision_count
from sextant.functions.numeric import half_up, result_limit, usd_text
from sextant.judge import LexicalJudge
from sextant.operators import (
    cache, expansion, graph, history, modules, ordering, score, search, tools, tree, usage,
)
from sextant.plans import code_texts, evidence, imports, logs, objectives
from sextant.plans.oracles import with_ctes
from sextant.session import bound_tasks, configure, cut_lineage
from sextant.sources.bindings import MODEL, Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

INTENT = "tighten the small ring and the hot gears"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use the shared CTEs."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, directory: plan(
            Tables(bound_tasks(configure(spark), directory), directory)
        )
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return plan

    return register


for _name, (_plan, _sql) in (imports.PLANS | code_texts.PLANS).items():
    query(_name, _sql)(_plan)


def joined(name: str, separator: str = ", ") -> Column:
    return F.array_join(F.col(name), separator).alias(name.split(".")[-1])


def micro(column: Column) -> Column:
    """Six decimals, ties up: the same in every engine."""
    return half_up(column, 1e6)


def past(t: Tables) -> DataFrame:
    return cut_lineage(t.history())


def scan(t: Tables, edges: DataFrame | None = None) -> DataFrame:
    """Run units, stored as a run is: the tools read them more than once."""
    history_, edges = past(t), t.edges() if edges is None else edges
    return cut_lineage(evidence.scan_units(t.units(), edges, history_, LexicalJudge()))


def scan_and_edges(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Run units and the import graph, both stored: the scan and its tools read the same edges."""
    found = cut_lineage(t.edges())
    return scan(t, found), found


def slim_scan(t: Tables) -> DataFrame:
    """Run units for one reader: not stored, whole evidence."""
    return evidence.scan_units(t.units(), t.edges(), past(t), LexicalJudge())


def slim_nodes(t: Tables) -> DataFrame:
    return cut_lineage(tree.node_table(cut_lineage(slim_scan(t))))


# --- units and scopes ---------------------------------------------------------------------------


@query("unit_filter_kind", "SELECT path, kind, bytes FROM targets")
def unit_filter_kind(t: Tables) -> DataFrame:
    return evidence.targets(t.units()).select("path", "kind", "bytes")


SCOPED = """
    SELECT area, count(*) AS units FROM (
      SELECT '' AS area FROM units UNION ALL SELECT split_part(path, '/', 1) FROM units
      UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM units)
    GROUP BY area"""


def scope_sizes(t: Tables) -> DataFrame:
    areas = F.explode(P.ancestors(F.col("path"))).alias("area")
    return t.units().select(areas).groupBy("area").agg(F.count(F.lit(1)).alias("units"))


@query("scope_filter", SCOPED)
def scope_filter(t: Tables) -> DataFrame:
    return scope_sizes(t)


@query(
    "result_limit",
    f"SELECT area, units, CAST(least(50, greatest(5, floor(units * 0.05::DOUBLE + 0.5))) AS INT) "
    f"AS result_limit FROM ({SCOPED})",
)
def limits(t: Tables) -> DataFrame:
    return scope_sizes(t).withColumn("result_limit", result_limit(F.col("units")))


IN_SCOPE = "Brand#1"


@query("units_in_scope", f"SELECT path, kind FROM units WHERE starts_with(path, '{IN_SCOPE}/')")
def units_in_scope(t: Tables) -> DataFrame:
    """Units of one area: a longer name that begins like it is another area."""
    return tools.units_in_scope(t.units(), IN_SCOPE).select("path", "kind")


@query(
    "units_in_order",
    """SELECT path, skipped, row_number() OVER (ORDER BY skipped, path) AS position
       FROM (SELECT path, false AS skipped FROM units UNION ALL SELECT path, true FROM left_out)""",
)
def units_in_order(t: Tables) -> DataFrame:
    return ordering.units_in_order(t.units(), left_out(t))


query("log_commits", logs.COMMITS_SQL)(logs.log_commits)
query("log_churn", logs.CHURN_SQL)(logs.log_churn)

SCRIPT_TESTS = "\\.(test|spec)\\.[cm]?[jt]sx?$"


@query(
    "path_kinds",
    f"""SELECT path, CASE regexp_extract(path, '\\.[^.]*$') WHEN '.ts' THEN 'typescript'
           WHEN '.js' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go'
           WHEN '.rs' THEN 'rust' END AS language,
         CASE WHEN path LIKE '%.rs' THEN path LIKE '%/tests/%'
           WHEN path LIKE '%.go' THEN path LIKE '%\\_test.go' ESCAPE '\\'
           WHEN path LIKE '%.py' THEN path LIKE '%/test\\_%' ESCAPE '\\'
           ELSE regexp_matches(path, '{SCRIPT_TESTS}') OR path LIKE '%/tests/%' END AS is_test,
         NOT regexp_matches(path, '\\.min\\.js$') AS is_candidate
       FROM source_paths""",
)
def path_kinds(t: Tables) -> DataFrame:
    path = F.col("path")
    return t.source_paths().select(
        path, P.language(path).alias("language"), P.is_test_path(path).alias("is_test"),
        P.is_candidate(path).alias("is_candidate"),
    )


def left_out(t: Tables) -> DataFrame:
    """Source paths that a scan leaves out: generated files."""
    return t.source_paths().where(~P.is_candidate(F.col("path"))).select("path")


@query("source_facts")
def source_facts(t: Tables) -> DataFrame:
    """Facts and complexity of every document read as source text of its language."""
    units = t.source_paths().withColumn("language", P.language(F.col("path")))
    return modules.with_facts(units).select(
        "path", "language", F.size("specifiers").alias("imports"), "type_imports",
        F.size("exports").alias("exports"), "type_exports", "complexity_facts.*",
    )


# --- history ------------------------------------------------------------------------------------


@query("commit_moments", "SELECT commit_id, date, recent, bot, bugfix, revert FROM moments")
def commit_moments(t: Tables) -> DataFrame:
    return t.commits().select("commit_id", "date", "recent", "bot", "bugfix", "revert")


@query("file_churn", "SELECT * FROM churn")
def file_churn(t: Tables) -> DataFrame:
    return t.churn()


@query("author_tally", "SELECT * FROM tally")
def author_tally(t: Tables) -> DataFrame:
    return history.author_tally(t.touches())


@query("authorship", "SELECT * FROM authorship")
def authorship(t: Tables) -> DataFrame:
    return history.authorship(history.author_tally(t.touches()))


@query("cochange_pairs", "SELECT * FROM pairs")
def cochange_pairs(t: Tables) -> DataFrame:
    return history.co_change_pairs(t.file_touches())


@query("cochange_guarded", "SELECT * FROM pairs6")
def cochange_guarded(t: Tables) -> DataFrame:
    return history.co_change_pairs(t.file_touches(), max_changeset=6)


def linked(t: Tables) -> DataFrame:
    numbers = t.path_numbers()
    touched = cut_lineage(t.file_touches(t.numbered_keys(numbers).drop("path")))
    counts = touched.groupBy("path_id").agg(F.count(F.lit(1)).alias("commits"))
    pairs = history.co_change_pairs(touched, key="path_id")
    named = cut_lineage(counts.join(numbers, "path_id"))
    return history.couplings(pairs, named, min_co_changes=2, key="path_id")


@query("coupling_strength", "SELECT * FROM couplings")
def coupling_strength(t: Tables) -> DataFrame:
    return linked(t)


@query("coupling_topk", "SELECT path, other, co_changes, strength, position FROM top")
def coupling_topk(t: Tables) -> DataFrame:
    return history.top_couplings(linked(t))


@query("coupling_counts", "SELECT * FROM partners")
def coupling_counts(t: Tables) -> DataFrame:
    return history.coupling_counts(linked(t))


@query(
    "coupled_pairs_total",
    "SELECT (SELECT count(*) FROM couplings) AS coupled_pairs, "
    "(SELECT count(*) FROM commits) AS commits",
)
def coupled_pairs_total(t: Tables) -> DataFrame:
    commits = t.read("orders").agg(F.count(F.lit(1))).scalar()
    return linked(t).agg(F.count(F.lit(1)).alias("coupled_pairs")).withColumn("commits", commits)


@query(
    "file_history",
    "SELECT path, commits, recent_commits, authors, recent_authors, primary_author_share, "
    "bug_fix_commits, revert_commits, last_modified, first_seen, sum_coupling, coupled FROM history",
)
def file_history(t: Tables) -> DataFrame:
    whole = t.history()
    return whole.withColumn("coupled", F.array_join("couplings.path", ",")).drop("couplings")


# --- graph --------------------------------------------------------------------------------------


@query("edges", "SELECT src, dst FROM edges")
def edges(t: Tables) -> DataFrame:
    return t.edges()


@query("fan_in_out", "SELECT path, fan_in, fan_out FROM fans")
def fan_in_out(t: Tables) -> DataFrame:
    return graph.fan_in_out(t.units(), t.edges())


@query("dependents", "SELECT dst AS path, src AS dependent FROM edges")
def dependents(t: Tables) -> DataFrame:
    return graph.dependents(t.edges())


# --- scoring ------------------------------------------------------------------------------------


@query(
    "percentile_ranks",
    "SELECT path, recent_commits, bug_fix_commits, max_cyclomatic, recent_commits_rank, "
    "bug_fix_commits_rank, max_cyclomatic_rank FROM ranks",
)
def percentile_ranks(t: Tables) -> DataFrame:
    return score.percentile_ranks(
        evidence.metrics(t.units(), cut_lineage(t.churn())),
        ["recent_commits", "bug_fix_commits", "max_cyclomatic"],
    )


@query("computed_signals", "SELECT path, churn, defect, complexity FROM signals")
def computed_signals(t: Tables) -> DataFrame:
    ranked = score.computed_signals(evidence.metrics(t.units(), cut_lineage(t.churn())))
    return ranked.select("path", "churn", "defect", "complexity")


@query(
    "judged_confidence",
    "SELECT path, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence FROM run",
)
def judged_confidence(t: Tables) -> DataFrame:
    return slim_scan(t).select("path", micro(F.col("confidence")).alias("confidence"))


@query("uncertain_dims", "SELECT path, uncertain FROM run")
def uncertain_dims(t: Tables) -> DataFrame:
    return slim_scan(t).select("path", joined("uncertain"))


@query("priority", "SELECT path, priority FROM run")
def priority(t: Tables) -> DataFrame:
    return slim_scan(t).select("path", "priority")


@query("drivers", "SELECT path, drivers FROM run")
def drivers(t: Tables) -> DataFrame:
    return slim_scan(t).select("path", joined("drivers"))


@query(
    "run_units",
    "SELECT path, kind, 'typescript' AS language, bytes, hash, priority, "
    "floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, drivers, uncertain, fan_in, fan_out, "
    "export AS exports, coalesce(commits, 0) AS commits, coalesce(coupled, '') AS coupled, "
    "max_cyclomatic, error FROM run LEFT JOIN history USING (path)",
)
def run_units(t: Tables) -> DataFrame:
    return scan(t).select(
        "path", "kind", "language", "bytes", "hash", "priority",
        micro(F.col("confidence")).alias("confidence"),
        joined("drivers"), joined("uncertain"), "fan_in", "fan_out", joined("exports"),
        F.coalesce("history.commits", F.lit(0)).alias("commits"),
        F.coalesce(F.array_join("history.couplings.path", ","), F.lit("")).alias("coupled"),
        F.col("complexity.max_cyclomatic").alias("max_cyclomatic"), "error",
    )


@query(
    "run_counts",
    "SELECT count(*) AS total, count_if(error IS NULL) AS scored, "
    "count_if(error IS NOT NULL) AS failed, "
    "(SELECT count(*) FROM left_out) AS skipped FROM run",
)
def run_counts(t: Tables) -> DataFrame:
    skipped = left_out(t).agg(F.count(F.lit(1))).scalar()
    return evidence.counts(slim_scan(t), skipped)


# --- tree ---------------------------------------------------------------------------------------


@query(
    "area_rollup",
    "SELECT path, units, priority, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, drivers, "
    "hot, error FROM areas",
)
def area_rollup(t: Tables) -> DataFrame:
    return tree.area_rollup(slim_scan(t)).select(
        "path", "units", "priority", micro(F.col("confidence")).alias("confidence"),
        joined("drivers"), "hot", "error",
    )


@query(
    "node_table",
    "SELECT path, name, kind, units, priority, drivers, hot, error, hint, depth, parent FROM nodes",
)
def node_table(t: Tables) -> DataFrame:
    return tree.node_table(cut_lineage(slim_scan(t))).select(
        "path", "name", "kind", "units", "priority", joined("drivers"), "hot", "error", "hint",
        "depth", "parent",
    )


@query(
    "area_children",
    "SELECT parent AS area, count(*) AS children, count_if(kind = 'area') AS sub_areas, "
    "min(path) AS first_child, max(priority) AS top_priority FROM nodes "
    "WHERE parent IS NOT NULL GROUP BY parent",
)
def area_children(t: Tables) -> DataFrame:
    nodes = tree.node_table(cut_lineage(slim_scan(t))).where(F.col("parent").isNotNull())
    return nodes.groupBy(F.col("parent").alias("area")).agg(
        F.count(F.lit(1)).alias("children"),
        F.count_if(F.col("kind") == "area").alias("sub_areas"),
        F.min("path").alias("first_child"),
        F.max("priority").alias("top_priority"),
    )


@query(
    "page_tree",
    """SELECT area, units, hot FROM (
         SELECT area, count(*) AS units,
                arg_min(path, row(-priority, string_split(path, '/'))) AS hot
         FROM (SELECT path, priority, unnest(list_transform(
                 range(0, len(string_split(path, '/'))),
                 lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS area
               FROM page_paths) GROUP BY area)""",
)
def page_tree(t: Tables) -> DataFrame:
    pages = t.read("pages").select(
        F.concat(
            F.regexp_replace("url", "^[a-z]+://", ""),
            F.lit("/page_"), F.col("page_id").cast("string"),
        ).alias("path"),
        F.length("html").cast("double").alias("priority"),
        F.lit(1.0).alias("confidence"),
        F.array(F.lit("size")).alias("drivers"),
        F.lit(None).cast("string").alias("error"),
    )
    return tree.area_rollup(pages).select(F.col("path").alias("area"), "units", "hot")


@query(
    "page_refs",
    """SELECT page_id, ref, count(*) AS refs FROM (
         SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages)
       GROUP BY 1, 2""",
)
def page_refs(t: Tables) -> DataFrame:
    refs = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ref")
    return (
        t.read("pages").select("page_id", refs)
        .groupBy("page_id", "ref").agg(F.count(F.lit(1)).alias("refs"))
    )


# --- evidence tools -----------------------------------------------------------------------------


@query(
    "hotspots",
    "SELECT path, priority, drivers FROM scored ORDER BY priority DESC, path LIMIT 10",
)
def hotspots(t: Tables) -> DataFrame:
    return tools.hotspots(slim_scan(t)).select("path", "priority", joined("drivers"))


@query(
    "hotspots_by_area",
    "SELECT area, position, path, priority, drivers FROM ranked_areas WHERE position <= 10",
)
def hotspots_by_area(t: Tables) -> DataFrame:
    top = tools.top_of_areas(slim_scan(t), ["drivers"], tools.MAX_HOTSPOTS)
    return top.select("area", "position", "path", "priority", joined("drivers"))


@query(
    "work_list",
    "SELECT path, priority, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, drivers, uncertain "
    "FROM scored ORDER BY priority DESC, path LIMIT 10",
)
def work_list(t: Tables) -> DataFrame:
    return tools.work_list(slim_scan(t)).select(
        "path", "priority", micro(F.col("confidence")).alias("confidence"),
        joined("drivers"), joined("uncertain"),
    )


@query(
    "work_by_area",
    "SELECT area, position, path, priority, drivers, uncertain FROM ranked_areas "
    "WHERE position <= 10",
)
def work_by_area(t: Tables) -> DataFrame:
    top = tools.top_of_areas(slim_scan(t), ["drivers", "uncertain"], tools.WORK_LIMIT)
    return top.select("area", "position", "path", "priority", joined("drivers"), joined("uncertain"))


@query(
    "catalog_units",
    "SELECT path AS value, 'priority ' || printf('%.1f', priority) || ', ' || CASE WHEN "
    "drivers = '' THEN 'no dominant driver' ELSE drivers END AS description "
    "FROM scored ORDER BY priority DESC, path LIMIT 40",
)
def catalog_units(t: Tables) -> DataFrame:
    return tools.catalog_units(slim_scan(t))


@query(
    "catalog_areas",
    "SELECT path AS value, 'area, ' || units || ' units, priority ' || printf('%.1f', priority) "
    "AS description FROM areas WHERE path <> '' ORDER BY priority DESC, path LIMIT 40",
)
def catalog_areas(t: Tables) -> DataFrame:
    return tools.catalog_areas(slim_nodes(t))


@query(
    "describe_unit",
    """SELECT path, priority, drivers, uncertain, fan_in, fan_out, max_cyclomatic,
         floor(max_cyclomatic / 10)::INT AS max_nesting, max_cyclomatic * 2 AS max_function_lines,
         coalesce(h.recent_commits, 0) AS recent_commits,
         coalesce(h.bug_fix_commits, 0) AS bug_fix_commits, coalesce(h.authors, 0) AS authors,
         coalesce(h.coupled, '') AS coupled, floor(r.churn * 1e6 + 0.5) / 1e6 AS churn
       FROM run r LEFT JOIN history h USING (path) WHERE error IS NULL""",
)
def describe_unit(t: Tables) -> DataFrame:
    return tools.scored_units(scan(t)).select(
        "path", "priority", joined("drivers"), joined("uncertain"), "fan_in", "fan_out",
        "complexity.max_cyclomatic", "complexity.max_nesting", "complexity.max_function_lines",
        F.coalesce("history.recent_commits", F.lit(0)).alias("recent_commits"),
        F.coalesce("history.bug_fix_commits", F.lit(0)).alias("bug_fix_commits"),
        F.coalesce("history.authors", F.lit(0)).alias("authors"),
        F.coalesce(F.array_join("history.couplings.path", ","), F.lit("")).alias("coupled"),
        micro(F.col("signals.churn")).alias("churn"),
    )


@query(
    "git_history",
    """SELECT path, commits, h.recent_commits, h.bug_fix_commits, revert_commits, authors,
         recent_authors,
         CAST(floor(primary_author_share * 100.0::DOUBLE + 0.5) AS BIGINT) || '%' AS top_author,
         last_modified, first_seen, sum_coupling FROM run JOIN history h USING (path)""",
)
def git_history(t: Tables) -> DataFrame:
    return tools.git_history(scan(t))


@query(
    "list_dependents",
    "SELECT dst AS path, src AS dependent FROM edges WHERE dst IN (SELECT path FROM targets)",
)
def list_dependents(t: Tables) -> DataFrame:
    run = evidence.targets(t.units()).select("path")
    return graph.dependents(t.edges()).join(run, "path", "left_semi")


@query(
    "list_coupling", "SELECT path, position, other, co_changes, strength, label FROM run_couplings"
)
def list_coupling(t: Tables) -> DataFrame:
    return tools.coupling_rows(scan(t))


@query("change_impact", "SELECT path, affected, priority, relation FROM impact")
def change_impact(t: Tables) -> DataFrame:
    run, found = scan_and_edges(t)
    return tools.impact_rows(found, tools.coupling_rows(run), run)


@query("lane_conflicts", "SELECT area, first_at, second_at, first, second FROM conflicts")
def lane_conflicts(t: Tables) -> DataFrame:
    run, found = scan_and_edges(t)
    return tools.lane_conflicts(cut_lineage(tools.work_members(run)), found)


@query(
    "safe_lanes",
    """WITH RECURSIVE placed AS (
         SELECT area, 0::BIGINT AS position, [0::BIGINT] AS lanes, '' AS path, 0.0::DOUBLE AS priority,
                0::BIGINT AS lane
         FROM (SELECT DISTINCT area FROM members)
         UNION ALL
         SELECT m.area, m.position,
                CASE WHEN f.fit = 0 THEN list_append(p.lanes, CAST(pow(2, m.position - 1) AS BIGINT))
                  ELSE list_transform(p.lanes, lambda x, i: CASE WHEN i = f.fit
                    THEN x + CAST(pow(2, m.position - 1) AS BIGINT) ELSE x END) END,
                m.path, m.priority,
                CASE WHEN f.fit = 0 THEN len(p.lanes) ELSE f.fit - 1 END
         FROM placed p JOIN masked m ON m.area = p.area AND m.position = p.position + 1,
         LATERAL (SELECT coalesce(list_position(list_transform(p.lanes, lambda x, i:
                    i > 1 AND (x & m.mask) = 0), true), 0) AS fit) f)
       SELECT area, lane, position, path, priority FROM placed WHERE position > 0""",
)
def safe_lanes(t: Tables) -> DataFrame:
    run, found = scan_and_edges(t)
    return tools.safe_lanes(cut_lineage(tools.work_members(run)), found)


# --- texts, hashes, fingerprints ------------------------------------------------------------------


@query(
    "doc_units",
    """SELECT path, sha256(content) AS hash, strlen(content) AS bytes,
         CASE WHEN content = '' THEN 0 ELSE length(content)
           - length(replace(content, chr(10), '')) + 1 END AS lines FROM texts""",
)
def doc_units(t: Tables) -> DataFrame:
    content = F.col("content")
    return t.texts().select(
        "path", digest.content_hash(content).alias("hash"),
        F.octet_length(content).alias("bytes"), digest.line_count(content).alias("lines"),
    )


@query(
    "repo_fingerprint",
    "SELECT substr(sha256(concat_ws('|', entries, l0, l1, l2, l3)), 1, 32) AS fingerprint, entries "
    "FROM lanes_in",
)
def repo_fingerprint(t: Tables) -> DataFrame:
    """Every text by its content, a null one as empty, and the source files left out of a scan."""
    content = F.coalesce("content", F.lit(""))
    units = t.texts().select("path", digest.content_hash(content).alias("hash"))
    return cache.repository_fingerprint(units, left_out(t))


@query(
    "repo_fingerprint_whole",
    "SELECT substr(sha256(concat_ws('|', entries, l0, l1, l2, l3)), 1, 32) AS fingerprint, entries "
    "FROM whole_in",
)
def repo_fingerprint_whole(t: Tables) -> DataFrame:
    """The content of every text counts, whatever its length; a null text is an empty one."""
    content = F.coalesce("content", F.lit(""))
    units = t.texts().select("path", digest.content_hash(content).alias("hash"))
    return cache.repository_fingerprint(units, units.where(F.lit(False)))


@query("graph_fingerprints", "SELECT path, graph_fingerprint FROM graph_prints")
def graph_fingerprints(t: Tables) -> DataFrame:
    return graph.graph_fingerprints(t.units(), t.edges())


def keyed(t: Tables) -> DataFrame:
    packed = past(t).select("path", F.struct(*evidence.HISTORY_FIELDS).alias("history"))
    units = evidence.targets(t.units()).join(packed, "path", "left")
    prints = graph.graph_fingerprints(t.units(), t.edges())
    return cut_lineage(cache.with_answer_keys(units, prints, MODEL))


@query("answer_keys", "SELECT path, state, key FROM keys")
def answer_keys(t: Tables) -> DataFrame:
    return keyed(t).select("path", "state", "key")


TOKENS = (
    "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', "
    "'g')), '[^a-z0-9]+'), lambda x: length(x) >= 3)"
)
STOP_LIST = "[" + ", ".join(f"'{word}'" for word in text.STOPWORDS) + "]"


@query(
    "identifier_tokens",
    f"""SELECT path, len(tokens) AS tokens, sha256(array_to_string(tokens, ' ')) AS token_hash,
          len(list_distinct(list_filter(tokens, lambda x: NOT list_contains({STOP_LIST}, x))))
            AS terms
        FROM (SELECT path, {TOKENS.format('content')} AS tokens FROM texts)""",
)
def identifier_tokens(t: Tables) -> DataFrame:
    content = F.col("content")
    return t.texts().select(
        "path",
        F.size(text.identifier_tokens(content)).alias("tokens"),
        F.sha2(F.array_join(text.identifier_tokens(content), " "), 256).alias("token_hash"),
        F.size(text.query_terms(content)).alias("terms"),
    )


@query(
    "intent_terms",
    f"""SELECT conv_id, turn, array_to_string(list_filter({TOKENS.format('text')},
          lambda x: NOT list_contains({STOP_LIST}, x)), ' ') AS words
        FROM conversations WHERE role = 'user'""",
)
def intent_terms(t: Tables) -> DataFrame:
    """What each user turn would be searched for, repeats kept."""
    stop = F.array(*[F.lit(word) for word in text.STOPWORDS])
    words = F.filter(
        text.identifier_tokens(F.col("text")), lambda word: ~F.array_contains(stop, word)
    )
    turns = t.read("conversations").where(F.col("role") == "user")
    return turns.select("conv_id", "turn", F.array_join(words, " ").alias("words"))


INTENT_LIST = "['tighten', 'small', 'ring', 'hot', 'gears']"


@query(
    "symbol_match",
    f"""SELECT path, score FROM (
          SELECT path, len(list_filter({INTENT_LIST}, lambda q: len(list_filter(tokens,
            lambda w: w = q OR (length(q) >= 4 AND starts_with(w, q))
              OR (length(w) >= 4 AND starts_with(q, w)))) > 0)) AS score
          FROM (SELECT path, list_concat({TOKENS.format('path')}, {TOKENS.format('export')})
                AS tokens FROM units)) WHERE score > 0""",
)
def symbol_match(t: Tables) -> DataFrame:
    nodes = t.units().select("path", P.base_name(F.col("path")).alias("name"), "exports",
                             F.lit("unit").alias("kind"))
    return search.symbol_matches(nodes, INTENT).select("path", "score")


def _decision_sql(lang: str) -> str:
    words, marks = DECISIONS[lang]
    pattern = rf"\b(?:{words})\b" if marks is None else rf"\b(?:{words})\b|{marks}"
    return f"len(regexp_extract_all(content, '{pattern}')) AS {lang}_decisions"


@query(
    "decision_counts",
    "SELECT path, " + ", ".join(_decision_sql(lang) for lang in DECISIONS) + " FROM texts",
)
def decision_counts(t: Tables) -> DataFrame:
    return t.texts().select(
        "path",
        *[
            decision_count(F.col("content"), lang).alias(f"{lang}_decisions")
            for lang in DECISIONS
        ],
    )


# --- caches -------------------------------------------------------------------------------------


def judgment_cache(keys: DataFrame) -> DataFrame:
    """Entries an earlier run left: small units, some of them read by another model, with another
    content or in another state."""
    size = F.col("complexity_facts.max_cyclomatic")
    model = F.when(size % 7 == 0, "judge-0").otherwise(MODEL)
    hash_ = F.when(size % 5 == 0, F.sha2(F.concat("hash", F.lit("-old")), 256)).otherwise(F.col("hash"))
    state = F.when(size % 3 == 0, F.concat("state", F.lit("0"))).otherwise(F.col("state"))
    then = keys.where(size < 40).select(digest.answer_key(hash_, model, state).alias("key"), model.alias("model"))
    return then.dropDuplicates(["key"]).withColumn("answers", F.lit("{}"))


@query("cache_hits", "SELECT path, key FROM keys WHERE key IN (SELECT key FROM cached)")
def cache_hits(t: Tables) -> DataFrame:
    keys = keyed(t)
    return cache.hits(keys, judgment_cache(keys)).select("path", "key")


@query("cache_misses", "SELECT path, key FROM keys WHERE key NOT IN (SELECT key FROM cached)")
def cache_misses(t: Tables) -> DataFrame:
    keys = keyed(t)
    return cache.misses(keys, judgment_cache(keys)).select("path", "key")


@query(
    "cache_prune",
    "SELECT DISTINCT key FROM keys WHERE key IN (SELECT key FROM cached) AND error IS NULL",
)
def cache_prune(t: Tables) -> DataFrame:
    keys = keyed(t)
    return cache.pruned(judgment_cache(keys), keys.where(F.col("error").isNull())).select("key")


@query(
    "cache_accounting",
    """SELECT count_if(NOT hit AND error IS NULL) AS calls, count_if(hit) AS cached,
         count_if(NOT hit AND error IS NOT NULL) AS failed,
         sum(CASE WHEN NOT hit THEN max_cyclomatic ELSE 0 END)::BIGINT AS input_tokens,
         0::BIGINT AS output_tokens
       FROM (SELECT *, key IN (SELECT key FROM cached) AS hit FROM keys)""",
)
def cache_accounting(t: Tables) -> DataFrame:
    keys = keyed(t)
    known = judgment_cache(keys).select("key", F.lit(True).alias("hit"))
    outcomes = keys.join(known, "key", "left").select(
        F.coalesce("hit", F.lit(False)).alias("hit"), "error",
        F.col("complexity_facts.max_cyclomatic").alias("input_tokens"),
        F.lit(0).alias("output_tokens"),
    )
    return cache.accounting(outcomes)


@query(
    "nav_prune",
    "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS model FROM events "
    "ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 2000",
)
def nav_prune(t: Tables) -> DataFrame:
    entries = t.read("events").select(
        F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("model"),
        F.col("ts").alias("created_at"),
    )
    return cache.newest(entries).select("key", "model")


# --- search -------------------------------------------------------------------------------------


@query("area_coverage", "SELECT area, path, priority FROM leaders")
def area_coverage(t: Tables) -> DataFrame:
    return search.area_leaders(slim_nodes(t)).select("area", "path", "priority")


NEAR = """SELECT area, path, kind, relation, slot FROM (
         SELECT *, row_number() OVER (PARTITION BY area ORDER BY up, priority DESC, path) AS slot
         FROM (SELECT o.area, o.path, o.kind, o.priority, o.up,
                 CASE WHEN up = 0 AND kind = 'unit' THEN 'file in this area'
                   WHEN up = 0 THEN 'sub-area' ELSE '2 levels down' END AS relation
               FROM offered o JOIN (SELECT area, count(*) AS children FROM offered WHERE up = 0
                 GROUP BY area) c USING (area) WHERE up = 0 OR children < 12))
       WHERE slot <= 40"""


@query("lookahead_descendants", NEAR)
def lookahead_descendants(t: Tables) -> DataFrame:
    near = search.neighbourhood(slim_nodes(t))
    return near.select("area", "path", "kind", "relation", "slot")


def search_map(t: Tables) -> search.SearchMap:
    """The search's tables, stored as a run stores them."""
    run, found = scan_and_edges(t)
    nodes = cut_lineage(tree.node_table(run))
    relations = search.relation_table(nodes, found, tools.coupling_rows(run))
    return search.SearchMap(nodes, relations, search.area_leaders(nodes))


RELATED = """
    SELECT src AS path, 'imports' AS strategy, dst AS target, 0 AS place FROM edges
    UNION ALL SELECT dst, 'dependents', src, 0 FROM edges
    UNION ALL SELECT path, 'coupled', other, position FROM top"""


@query(
    "relation_table",
    f"SELECT path, strategy, target, place FROM ({RELATED}) "
    "WHERE path IN (SELECT path FROM run) AND target IN (SELECT path FROM run)",
)
def relation_table(t: Tables) -> DataFrame:
    return search_map(t).relations.select("path", "strategy", "target", "place")


@query(
    "anchor_relations",
    f"""SELECT area, strategy, path, slot FROM (
          SELECT a.path AS area, r.strategy, r.target AS path, row_number() OVER (
            PARTITION BY a.path, r.strategy ORDER BY r.place, r.target) AS slot
          FROM areas a JOIN ({RELATED}) r ON r.path = a.hot
          WHERE r.target IN (SELECT path FROM run)) WHERE slot <= 6""",
)
def anchor_relations(t: Tables) -> DataFrame:
    found = search_map(t)
    return search.anchor_relations(found.nodes, found.relations).select(
        "area", "strategy", "path", "slot"
    )


def _pick(strategy: str, before: str) -> str:
    """What a strategy adds to what is picked before it."""
    return f"""SELECT area, path, strategy, slot FROM (
      SELECT *, row_number() OVER (PARTITION BY area ORDER BY place, path) AS slot FROM z_offered r
      WHERE strategy = '{strategy}' AND NOT EXISTS (
        SELECT 1 FROM {before} b WHERE b.area = r.area AND b.path = r.path)) WHERE slot <= 6"""


@query(
    "expand_all",
    f"""SELECT * FROM (
      WITH z_near AS (SELECT area, path, 'descend' AS strategy, slot FROM ({NEAR})),
      z_offered AS (
        SELECT a.path AS area, x.strategy, x.target AS path, x.place
        FROM areas a JOIN ({RELATED}) x ON x.path = a.hot
        WHERE x.target IN (SELECT path FROM run)),
      z_one AS (SELECT * FROM z_near UNION ALL {_pick("imports", "z_near")}),
      z_two AS (SELECT * FROM z_one UNION ALL {_pick("dependents", "z_one")})
      SELECT * FROM z_two UNION ALL {_pick("coupled", "z_two")})""",
)
def expand_all(t: Tables) -> DataFrame:
    found = search_map(t)
    return expansion.expand_all(found.nodes, found.relations)


CANDIDATE = "path string, strategy string, relation string, weight double"


def ready_map(t: Tables) -> search.SearchMap:
    """A search looks rows up step by step: all of its tables are stored first."""
    found = search_map(t)
    return search.SearchMap(
        found.nodes, cut_lineage(found.relations), cut_lineage(found.leaders)
    )


@query("expand_root")
def expand_root(t: Tables) -> DataFrame:
    found = ready_map(t)
    root = search._node_rows(found, [""])[""]
    rows = [
        (c.node["path"], c.strategy, c.relation, float(c.weight))
        for c in search.expand(found, root, set(), intent=INTENT)
    ]
    return t.spark.createDataFrame(rows, CANDIDATE)


query("symbol_lookup", objectives.LOOKUP_SQL)(objectives.symbol_lookup)
query("symbol_tokens", objectives.TOKENS_SQL)(objectives.symbol_tokens)
query("search_all")(objectives.searched(ready_map))


OPPORTUNITY = (
    "path string, relevance double, relevance_confidence double, priority double, "
    "drivers array<string>, confidence double, trail array<struct<from:string,chosen:string,"
    "confidence:double,strategy:string,relation:string>>"
)


@query("search_opportunities")
def search_opportunities(t: Tables) -> DataFrame:
    result = search.search(ready_map(t), INTENT, LexicalJudge())
    return t.spark.createDataFrame(result.opportunities, OPPORTUNITY)


# --- usage and economics --------------------------------------------------------------------------

COST = (
    "(input_tokens / 1e6::DOUBLE) * 0.042::DOUBLE + (output_tokens / 1e6::DOUBLE) * 0.0::DOUBLE"
)


@query(
    "usage_rows",
    f"""SELECT id, started_at, model, calls, cached, failed, input_tokens, output_tokens,
          {COST} AS cost_usd, CASE WHEN {COST} = 0 THEN '$0' WHEN {COST} < 0.01
            THEN '$' || printf('%.5f', {COST}) ELSE '$' || printf('%.4f', {COST}) END AS cost_text
        FROM ledger""",
)
def usage_rows(t: Tables) -> DataFrame:
    return usage.usage_rows(t.ledger()).withColumn("cost_text", usd_text(F.col("cost_usd")))


@query(
    "usage_latest",
    f"SELECT id, started_at, calls, {COST} AS cost_usd FROM ledger "
    "ORDER BY started_at DESC, id LIMIT 10",
)
def usage_latest(t: Tables) -> DataFrame:
    rows = usage.latest_runs(usage.usage_rows(t.ledger()), 10)
    return rows.select("id", "started_at", "calls", "cost_usd")


@query(
    "usage_totals",
    f"""SELECT count(*) AS runs, sum(calls)::BIGINT AS calls, sum(cached)::BIGINT AS cached,
          sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
          floor(sum({COST}) * 1e6 + 0.5) / 1e6 AS cost_usd FROM ledger""",
)
def usage_totals(t: Tables) -> DataFrame:
    totals = usage.usage_totals(usage.usage_rows(t.ledger()))
    return totals.withColumn("cost_usd", micro(F.col("cost_usd")))


@query(
    "economics",
    """SELECT cold_in AS cold_input_tokens, warm_in AS warm_input_tokens, query_in AS query_input_tokens,
         cold_in + warm_in + query_in AS total_input_tokens,
         floor(mean * 1e6 + 0.5) / 1e6 AS query_mean_tokens, middle AS query_median_tokens,
         floor(CASE WHEN tried > 0 THEN cached / tried ELSE 0 END * 1e6 + 0.5) / 1e6 AS warm_cache_hit_rate,
         floor(((cold_in + warm_in + query_in) / 1e6 * 0.042) * 1e6 + 0.5) / 1e6 AS total_cost_usd
       FROM (
         SELECT coalesce(sum(input_tokens) FILTER (at = 1), 0)::BIGINT AS cold_in,
           coalesce(sum(input_tokens) FILTER (at = 2), 0)::BIGINT AS warm_in,
           coalesce(sum(input_tokens) FILTER (at > 2), 0)::BIGINT AS query_in,
           coalesce(avg(input_tokens) FILTER (at > 2), 0) AS mean,
           coalesce(median(input_tokens) FILTER (at > 2), 0)::DOUBLE AS middle,
           coalesce(sum(cached) FILTER (at = 2), 0)::DOUBLE AS cached,
           coalesce(sum(calls + cached) FILTER (at = 2), 0)::DOUBLE AS tried
         FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(id, '^run_(.*)_', 1), model
           ORDER BY started_at, id) AS "at" FROM ledger))""".replace("(at ", '("at" '),
)
def economics(t: Tables) -> DataFrame:
    user = F.regexp_extract("id", "^run_(.*)_", 1)
    summary = usage.ledger_economics(cut_lineage(t.ledger()).withColumn("user", user))
    return summary.withColumns(
        {
            "query_mean_tokens": micro(F.col("query_mean_tokens")),
            "warm_cache_hit_rate": micro(F.col("warm_cache_hit_rate")),
            "total_cost_usd": micro(F.col("total_cost_usd")),
        }
    )
