"""Time the headline queries on the Parquet tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sextant.judge import metered_judge  # noqa: E402
from sextant.plans.catalog import QUERIES  # noqa: E402
from sextant.plans.economics import measure  # noqa: E402
from sextant.plans.store import Store  # noqa: E402
from sextant.session import build_session  # noqa: E402

HEADLINE = [
    "file_churn", "authorship", "cochange_pairs", "coupling_topk", "file_history",
    "edges", "import_graph", "source_facts", "fan_in_out", "percentile_ranks", "priority", "run_units",
    "node_table", "hotspots_by_area", "lookahead_descendants", "change_impact", "safe_lanes",
    "answer_keys", "cache_misses", "doc_units", "repo_fingerprint", "identifier_tokens",
    "decision_counts", "page_refs", "page_tree", "usage_rows", "economics",
    "expand_all", "search_opportunities", "package_fans", "package_impact", "complexity_python",
    "complexity_go", "symbol_lookup",
]


def judge_economics(spark) -> dict:
    """Token cost of scanning and searching this repository with a judge that counts tokens."""
    store = Store(spark, tempfile.mkdtemp(prefix="bench-state-"))
    root = os.path.dirname(os.path.abspath(__file__))
    report, summary = measure(spark, root, metered_judge(), store)
    times = {f"{kind}_ms": report[kind]["elapsed_ms"] for kind in ("cold", "warm")}
    return {**summary, **times, "query_ms": [q["elapsed_ms"] for q in report["queries"]]}


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("file_churn", "identifier_tokens"):  # load classes, start the executors
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    economics = {} if sys.argv[1:] else judge_economics(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/")),
                "economics": economics,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
