import json
from pathlib import Path

import pytest

from sextant.judge import metered_judge
from sextant.operators.usage import economics
from sextant.plans.economics import measure
from sextant.plans.store import Store


def summary_of(spark, tokens, cold=None, warm=None):
    rows = [(t, 1, "m") for t in tokens]
    df = spark.createDataFrame(rows, "input_tokens bigint, output_tokens bigint, model string")
    return economics(df, cold, warm).first()


def test_summary(spark):
    cold = {"input_tokens": 1000000, "output_tokens": 5, "calls": 10, "cached": 0}
    warm = {"input_tokens": 0, "output_tokens": 0, "calls": 1, "cached": 9}
    got = summary_of(spark, [2000, 4000], cold, warm)
    assert (got["query_mean_tokens"], got["query_median_tokens"]) == (3000.0, 3000.0)
    assert got["total_input_tokens"] == 1006000 and got["warm_cache_hit_rate"] == 0.9
    assert got["total_cost_usd"] == pytest.approx(1.006 * 0.042)
    empty = summary_of(spark, [])
    assert (empty["query_mean_tokens"], empty["query_median_tokens"]) == (0.0, 0.0)
    assert empty["warm_cache_hit_rate"] == 0.0
    assert summary_of(spark, [100, 300, 200])["query_median_tokens"] == 200.0


def test_measure(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src" / "cache.py").write_text("def load_cache():\n    return 1\n")
    (root / "src" / "app.py").write_text("from src.cache import load_cache\n")
    store = Store(spark, str(tmp_path / "state"))
    measured, summary = measure(spark, str(root), metered_judge(2), store, ["load the cache"])
    assert measured["cold"]["calls"] == 2 and measured["warm"]["cached"] == 2
    assert summary["warm_cache_hit_rate"] == 1.0 and summary["warm_input_tokens"] == 0
    assert summary["cold_input_tokens"] > 0 and summary["query_input_tokens"] > 0
    kept = [json.loads(f.read_text()) for f in Path(store.folder, "bench").iterdir()]
    assert kept[0]["summary"]["total_input_tokens"] == summary["total_input_tokens"]
