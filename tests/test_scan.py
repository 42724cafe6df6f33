import pytest
from pyspark.sql import functions as F

from sextant.errors import SextantError
from sextant.judge import CallableJudge, Choice, LexicalJudge, Relevance
from sextant.operators import cache
from sextant.plans.intent import default_results, project_fields, run_intent
from sextant.plans.scan import ensure_run, is_current, run_scan
from sextant.plans.store import Store, nav_key, prune_nav, read_json, state_dir, write_json
from sextant.sources import files
from sextant.sources.ignore import ignored, parse_rules


@pytest.fixture
def project(tmp_path, git):
    root = tmp_path / "proj"
    texts = {
        "src/a.ts": "import { b } from './b';\nexport const loadCache = () => b;\n",
        "src/b.ts": "export const b = (x) => x ? 1 : 2;\n",
        "src/copy/b.ts": "export const b = (x) => x ? 1 : 2;\n",
        "src/b.test.ts": "import { b } from './b';\n",
        "src/types.d.ts": "export type A = 1;\n", "src/bundle.min.ts": "export const m = 1;\n",
        "ignored/x.ts": "export const x = 1;\n", "scratch/skip.ts": "export const s = 1;\n",
        "node_modules/pkg/index.ts": "export const x = 1;\n", "lib/tool.py": "def run():\n    pass\n",
        ".gitignore": "ignored/\n", ".sextantignore": "scratch/\n",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "fix: all of it")
    return root


def test_discovery(spark, project):
    units = files.units_of(files.discover(spark, str(project)))
    assert {r["path"]: r["kind"] for r in units.collect()} == {
        "src/a.ts": "source", "src/b.ts": "source", "src/copy/b.ts": "source",
        "src/b.test.ts": "test", "lib/tool.py": "source",
    }
    row = units.where("path = 'lib/tool.py'").first()
    assert (row["bytes"], row["lines"], row["language"]) == (20, 3, "python")
    assert files.discovery_mode(str(project)) == "git"
    small = files.discover(spark, str(project), max_bytes=10)
    assert files.units_of(small).count() == 0
    assert {r["reason"] for r in files.skipped_of(small).collect()} == {"too_large"}


def test_walk_outside_git(spark, tmp_path):
    (tmp_path / "src" / ".cache").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("export const a = 1;\n")
    (tmp_path / "src" / ".cache" / "b.ts").write_text("")
    found = files.units_of(files.discover(spark, str(tmp_path)))
    assert [r["path"] for r in found.collect()] == ["src/a.ts"]
    assert files.discovery_mode(str(tmp_path)) == "walk"
    assert files.head_commit(str(tmp_path)) is None


def test_ignore_rules(spark):
    rules = parse_rules("# note\n*.gen.ts\n/top.ts\ndocs/\nlogs/**/x.ts\n!keep.gen.ts\ndocs/a.ts\n")
    cases = {
        "a.gen.ts": True, "deep/a.gen.ts": True, "keep.gen.ts": False, "top.ts": True,
        "deep/top.ts": False, "docs/a.ts": True, "x/docs/b.ts": True, "docs.ts": False,
        "logs/x.ts": True, "logs/a/b/x.ts": True, "logs/y.ts": False,
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    rows = df.select("path", ignored(F.col("path"), rules)).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_go_module(tmp_path):
    assert files.go_module(str(tmp_path)) is None
    (tmp_path / "go.mod").write_text("// x\nmodule example.com/mod\n\ngo 1.22\n")
    assert files.go_module(str(tmp_path)) == "example.com/mod"


def remote(fail=(), calls=None):
    """Judge backed by functions, as a remote model would be."""

    def review(payload):
        unit = payload["unit"]
        if unit["path"] in fail:
            raise RuntimeError("no answer")
        assert unit["content"] and "fan_in" in unit
        pair = (1.0, 0.9)
        return {
            "criticality": (unit["fan_in"], 0.9), "blast_radius": pair, "cohesion": pair,
            "change_risk": pair, "input_tokens": 100, "output_tokens": 7,
        }

    def rank(intent, here, offered):
        if calls is not None:
            calls.append([c["description"] for c in offered])
        return Choice({c["path"]: 1 / len(offered) for c in offered}, offered[0]["path"], 0.9, 5, 1)

    def score(intent, paths):
        return Relevance({p: (0.9 if p == "src/a.ts" else 0.1, 0.8) for p in paths}, 3, 1)

    return CallableJudge("remote-1", review, rank, score, parallelism=2)


def test_scan_search_and_caches(spark, project, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    root, calls = str(project), []
    judge = remote(fail=("lib/tool.py",), calls=calls)
    run = run_scan(spark, root, judge, store)
    assert run.record["counts"] == {"total": 4, "scored": 3, "failed": 1, "skipped": 0}
    # b.ts and its copy differ in graph state, so each is judged.
    assert run.record["usage"] == {
        "calls": 3, "cached": 0, "failed": 1, "input_tokens": 300, "output_tokens": 21
    }
    units = {r["path"]: r for r in run.tables["units"].collect()}
    assert units["lib/tool.py"]["error"] == "no answer" and units["lib/tool.py"]["priority"] == 0
    assert (units["src/b.ts"]["fan_in"], units["src/a.ts"]["fan_out"]) == (2, 1)
    assert units["src/b.ts"]["complexity"]["max_cyclomatic"] == 2
    assert units["src/a.ts"]["history"]["bug_fix_commits"] == 1
    assert units["src/a.ts"]["exports"] == ["loadCache"]

    again, scanned = ensure_run(spark, root, judge, store)
    assert not scanned and again.id == run.id
    warm = run_scan(spark, root, judge, store)
    assert {k: warm.record["usage"][k] for k in ("calls", "cached", "failed")} == {
        "calls": 0, "cached": 3, "failed": 1
    }
    assert store.load_run().id == warm.id
    forced = run_scan(spark, root, judge, store, force=True)
    assert forced.record["usage"]["calls"] == 3

    view = run_intent(store, judge, "load the cache")
    assert view["opportunities"][0]["path"] == "src/a.ts"
    assert view["opportunities"][0]["stats"]["fan_out"] == 1
    assert view["usage"]["input_tokens"] == 5 * view["steps"] + 3
    assert any("exports: loadCache" in text for text in calls[0])
    asked = len(calls)
    repeat = run_intent(store, judge, "load the cache")
    assert repeat["usage"] == {"input_tokens": 0, "output_tokens": 0} and len(calls) == asked
    assert run_intent(store, judge, "load the cache", fresh=True)["usage"]["input_tokens"] > 0
    with pytest.raises(SextantError) as missing:
        run_intent(store, judge, "x", path="nope")
    assert missing.value.code == "USAGE"
    inside = run_intent(store, judge, "load", path="lib")
    assert inside["steps"] == 1

    ledger = store.ledger()
    assert ledger.count() == 3

    (project / "src" / "new.ts").write_text("export const n = 1;\n")
    assert not is_current(spark, forced.record, root)
    assert not is_current(spark, {**forced.record, "model": "structural"}, root)



def test_copies_share_one_judgment(spark, tmp_path):
    root = tmp_path / "copies"
    for n in range(6):
        (root / f"d{n}").mkdir(parents=True)
        (root / f"d{n}" / "same.py").write_text("x = 1\n")
    store = Store(spark, str(tmp_path / "state"))
    run = run_scan(spark, str(root), remote(), store)
    assert run.record["usage"] == {
        "calls": 1, "cached": 5, "failed": 0, "input_tokens": 100, "output_tokens": 7
    }
    assert run.record["counts"]["scored"] == 6


def test_missing_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load_run() is None and store.ledger() is None
    for call in (
        lambda: ensure_run(spark, str(tmp_path), LexicalJudge(), store, run_id="zzz"),
        lambda: run_intent(store, LexicalJudge(), "x"),
    ):
        with pytest.raises(SextantError) as missing:
            call()
        assert missing.value.exit_code == 4
    made = ensure_run(spark, str(tmp_path), None, store, scan=lambda *a, **k: "made")
    assert made == ("made", True)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    def mark(units, skipped=()):
        units = spark.createDataFrame(units, "path string, hash string")
        skipped = spark.createDataFrame(list(skipped), "path string")
        return cache.repository_fingerprint(units, skipped).first()["fingerprint"]

    base = mark([("a", "1"), ("b", "2")])
    assert base == mark([("b", "2"), ("a", "1")]) and len(base) == 32
    others = [mark([("a", "1"), ("b", "3")]), mark([("a", "1")]), mark([("a", "1"), ("b", "2")], [("c",)]),
              mark([("a", "1"), ("b", "2"), ("b", "2")]), mark([("a", "2"), ("b", "1")])]
    assert len({base, *others}) == 6


def test_navigation_cache():
    entries = {k: {"key": k, "created_at": t} for k, t in (("a", "1"), ("b", "3"), ("c", "2"))}
    assert list(prune_nav(entries, 2)) == ["b", "c"]
    assert nav_key("rank", "m", "i", {"a": 1}) != nav_key("score", "m", "i", {"a": 1})
    assert len(nav_key("rank", "m", "i", [])) == 32


def test_state_folder(tmp_path):
    assert state_dir("/x/my repo!", {"SEXTANT_HOME": "/h"}).startswith("/h/repos/my-repo-")
    assert state_dir("/x", {"SEXTANT_STATE_DIR": "/exact"}) == "/exact"
    write_json(tmp_path / "d" / "x.json", {"a": 1})
    assert read_json(tmp_path / "d" / "x.json") == {"a": 1}
    (tmp_path / "bad.json").write_text("{")
    assert read_json(tmp_path / "bad.json") is None and read_json(tmp_path / "no.json") is None


def test_result_sizes():
    sizes = [default_results(n) for n in (0, 32, 100, 200, 400, 1000, 10000)]
    assert sizes == [5, 5, 5, 10, 20, 50, 50]
    view = {"opportunities": [{"path": "a", "relevance": 1, "x": 2}], "steps": 1}
    assert project_fields(view, "relevance, path,nope")["opportunities"] == [
        {"relevance": 1, "path": "a"}
    ]
    assert project_fields(view, None) is view
