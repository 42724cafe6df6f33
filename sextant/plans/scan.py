"""The wide pass: discover, derive evidence, judge what changed, score, store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.errors import SextantError
from sextant.functions.digest import content_hash
from sextant.judge import ANSWERS_TYPE, DEPENDENT_SAMPLE, Judge
from sextant.operators import cache as C
from sextant.operators import history, modules, packages, search, tools, tree
from sextant.plans.evidence import counts, gather, unit_rows
from sextant.plans.store import Run, Store, now_text
from sextant.session import cut_lineage
from sextant.sources import files as files_
from sextant.sources import gitlog


def judged(
    keyed: DataFrame, cached: DataFrame, judge: Judge, contents: DataFrame | None, write
) -> tuple[DataFrame, DataFrame]:
    """Answers for every unit, and the new judgments.

    Only keys the cache does not know are judged, one unit per key: copies of a file in the same
    state share its judgment. The judgments are written before they are used, so no call to the
    judge is repeated when a later stage has to be recomputed.
    """
    missing = C.misses(keyed, cached)
    first = missing.groupBy("key").agg(F.min("path").alias("path"))
    asked = missing.join(first.select("key", "path"), ["key", "path"])
    if contents is not None:
        asked = asked.join(contents, "path")
    reviewed = judge.review(asked).select(
        "key", "path", "hash", "state", "answers", "error", "input_tokens", "output_tokens"
    )
    fresh = write("reviews", reviewed)
    known = cached.select("key", F.col("answers").alias("known"))
    new = fresh.select(
        "key", F.col("answers").alias("new"), F.col("error").alias("failure"),
        F.col("path").alias("asked"), "input_tokens", "output_tokens",
    )
    joined = keyed.join(known, "key", "left").join(new, "key", "left")
    failed = F.coalesce("failure", F.lit("")) != ""
    answered = joined.withColumns(
        {
            "hit": F.col("known").isNotNull() | (~failed & (F.col("asked") != F.col("path"))),
            "answers": F.coalesce("known", "new"),
            "error": F.when(F.col("known").isNull(), F.col("failure")),
            "input_tokens": F.when(F.col("asked") == F.col("path"), F.col("input_tokens")),
            "output_tokens": F.when(F.col("asked") == F.col("path"), F.col("output_tokens")),
        }
    ).drop("known", "new", "failure", "asked")
    return answered, fresh


def cache_entries(
    cached: DataFrame, keyed: DataFrame, fresh: DataFrame, model: str, at: str
) -> DataFrame:
    """Entries this run used, old and new; failures are not kept."""
    new = fresh.where(F.coalesce("error", F.lit("")) == "").select(
        "key", "hash", "path", F.lit(model).alias("model"), "state", F.lit(at).alias("created_at"),
        F.col("answers").cast(ANSWERS_TYPE).alias("answers"),
    )
    return C.pruned(cached, keyed).select(*new.columns).unionByName(new)


def stored_map(run_units: DataFrame, edges: DataFrame | packages.Links, write) -> None:
    """Node, relation and leader tables, range-partitioned for the search's look-ups."""
    nodes = tree.with_child_names(tree.node_table(run_units))
    nodes = write("nodes", nodes.repartitionByRange("path").sortWithinPartitions("path"))
    relations = search.relation_table(nodes, edges, tools.coupling_rows(run_units))
    write("relations", relations.repartitionByRange("path", "target").sortWithinPartitions("path"))
    write("leaders", search.area_leaders(nodes))


def run_scan(
    spark: SparkSession,
    root: str,
    judge: Judge,
    store: Store,
    force: bool = False,
    run_id: str | None = None,
    as_of: str | None = None,
    max_bytes: int | None = None,
) -> Run:
    run_id = run_id or f"run_{uuid.uuid4().hex[:16]}"
    started = now_text()

    def write(name: str, df: DataFrame) -> DataFrame:
        return store.write_table(run_id, name, df)

    found = cut_lineage(files_.discover(spark, root, max_bytes=max_bytes))
    skipped = write("skipped", files_.skipped_of(found))
    units = cut_lineage(modules.with_facts(files_.units_of(found)).drop("content"))
    fingerprint = C.repository_fingerprint(units, skipped).first()["fingerprint"]
    found_links = modules.resolve(units, files_.go_module(root))
    links = packages.Links(
        write("edges", found_links.direct), write("uses", found_links.uses),
        write("members", found_links.members),
    )
    instant = F.lit(as_of or started).cast("timestamp")
    commits = gitlog.parse_records(gitlog.read_log(spark, root))
    touched = cut_lineage(history.keep_known(gitlog.touches(commits, instant), units))
    past = cut_lineage(history.file_history(touched))
    evidence = gather(units, links, past)
    prints = packages.graph_fingerprints(units, links)
    keyed = cut_lineage(C.with_answer_keys(evidence, prints, judge.model))
    cached = store.load_cache()
    if force:
        cached = cached.where(F.lit(False))
    contents = (
        found.where(F.col("content").isNotNull())
        .select("path", "content")
        .join(packages.review_context(links, DEPENDENT_SAMPLE), "path", "left")
    )
    answered, fresh = judged(keyed, cached, judge, contents, write)
    answered = cut_lineage(answered)
    run_units = write("units", unit_rows(answered))
    stored_map(run_units, links, write)
    usage = C.accounting(answered).first().asDict()
    total = counts(run_units, F.lit(skipped.count())).first().asDict()
    store.save_cache(cache_entries(cached, keyed, fresh, judge.model, started), run_id)
    record = {
        "id": run_id, "started_at": started, "finished_at": now_text(), "root": root,
        "mode": files_.discovery_mode(root), "model": judge.model, "fingerprint": fingerprint,
        "commit": files_.head_commit(root), "counts": total, "usage": usage,
        "max_bytes": max_bytes,
    }
    store.finish_run(record)
    return store.load_run(run_id)


def is_current(spark: SparkSession, record: dict, root: str) -> bool:
    """A run holds while the content of all files does; runs without a judge are stale."""
    if not record.get("fingerprint") or record.get("model") == "structural":
        return False
    found = files_.discover(spark, root, max_bytes=record.get("max_bytes"))
    # Only hashes are stored; the texts are read once and go no further.
    state = cut_lineage(
        found.select("path", "reason", "size", content_hash(F.col("content")).alias("hash"))
    )
    known = state.where("reason IS NULL").select("path", "hash")
    now = C.repository_fingerprint(known, files_.skipped_of(state))
    return now.first()["fingerprint"] == record["fingerprint"]


def ensure_run(
    spark: SparkSession,
    root: str,
    judge: Judge,
    store: Store,
    run_id: str | None = None,
    force: bool = False,
    scan=run_scan,
) -> tuple[Run, bool]:
    """The named run, else the latest one if it is current, else a new scan."""
    if run_id:
        run = store.load_run(run_id)
        if run is None:
            raise SextantError("RUN_MISSING", f"No run {run_id}.", "List runs with `usage`.")
        return run, False
    if not force:
        latest = store.load_run()
        if latest and is_current(spark, latest.record, root):
            return latest, False
    return scan(spark, root, judge, store, force=force), True
