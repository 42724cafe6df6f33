import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sextant.operators import history as H
from sextant.sources import gitlog

NOW = "2026-06-01T00:00:00Z"


def touches_of(spark, commits, as_of=NOW):
    rows = [(str(n), *commit) for n, commit in enumerate(commits)]
    df = spark.createDataFrame(
        rows, "commit_id string, author string, date string, subject string, files array<string>"
    )
    return gitlog.touches(df, F.lit(as_of).cast("timestamp"))


def by_path(df):
    return {row["path"]: row.asDict(recursive=True) for row in df.collect()}


def test_log_records(spark):
    text = (
        "\x1eh1\x1fAda\x1f2026-01-01T00:00:00+00:00\x1ffix: a\x1fb\na.ts\n\n  b.ts \n"
        "\x1eshort\x1eh2\x1fBob\x1f2026-01-02T00:00:00+00:00\x1fadd\n"
    )
    df = spark.createDataFrame([(r,) for r in text.split("\x1e")], "record string")
    rows = {row["commit_id"]: row for row in gitlog.parse_records(df).collect()}
    assert set(rows) == {"h1", "h2"}
    assert rows["h1"]["subject"] == "fix: a\x1fb"
    assert rows["h1"]["files"] == ["a.ts", "b.ts"]
    assert rows["h2"]["files"] == []


def test_moments(spark):
    day = "2026-05-30T00:00:00+02:00"
    cases = [
        ("Ada", day, "fix crash"), ("dependabot[bot]", day, "bump"), ("Ada", day, "prefix it"),
        ("Ada", "2025-01-01T00:00:00Z", "Revert thing"), ("robot", day, "réfix fixé"),
        ("renovate", day, "bugs"), ("Ada", "2026-03-03T00:00:00Z", "hotfix"),
    ]
    df = spark.createDataFrame(cases, "author string, date string, subject string")
    got = H.with_moment(df, F.lit(NOW).cast("timestamp")).collect()
    flags = [(r["recent"], r["bot"], r["bugfix"], r["revert"]) for r in got]
    assert flags == [
        (True, False, True, False), (True, True, False, False), (True, False, False, False),
        (False, False, True, True), (True, True, True, False), (True, True, False, False),
        (True, False, True, False),
    ]


def test_dates_keep_text_order(spark):
    dates = [
        "2026-01-01T10:00:00+02:00", "2026-01-01T10:00:00-05:00", "2026-01-01T10:00:00Z",
        "2025-12-31T23:59:59+14:00", "2026-01-01T10:00:00+00:00",
    ]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    rows = df.select("d", H.date_rank(F.col("d")).alias("r")).collect()
    assert [r["d"] for r in sorted(rows, key=lambda r: r["r"])] == sorted(dates)
    back = df.select(H.date_text(H.date_rank(F.col("d")))).collect()
    assert [r[0] for r in back] == dates


def test_git_history_end_to_end(spark, tmp_path, git):
    git(tmp_path, "init", "-q")

    def commit(names, message, author):
        for name in names:
            with open(tmp_path / name, "a") as file:
                file.write("x\n")
        git(tmp_path, "add", "-A")
        git(tmp_path, "commit", "-qm", message, name=author)

    commit(["a.ts"], "add a", "Alice")
    commit(["b.ts"], "fix: add b", "Alice")
    commit(["a.ts", "b.ts"], "fix: both", "Bob")
    commit(["a.ts", "b.ts"], "bug: both again", "Bob")
    commits = gitlog.parse_records(gitlog.read_log(spark, str(tmp_path)))
    assert commits.count() == 4
    got = by_path(
        H.file_history(gitlog.touches(commits, F.current_timestamp()), min_co_changes=2)
    )
    a, b = got["a.ts"], got["b.ts"]
    assert (a["commits"], a["recent_commits"], a["authors"], a["bug_fix_commits"]) == (3, 3, 2, 2)
    assert b["bug_fix_commits"] == 3
    assert a["sum_coupling"] == 1
    assert [(c["path"], c["co_changes"]) for c in a["couplings"]] == [("b.ts", 2)]
    assert a["primary_author_share"] == 2 / 3


def test_no_history_outside_git(spark, tmp_path):
    assert gitlog.parse_records(gitlog.read_log(spark, str(tmp_path))).count() == 0


def model_history(commits, as_of, max_changeset, min_co, top):
    cutoff = datetime.fromisoformat(as_of) - timedelta(days=90)
    stats = defaultdict(Counter)
    authors = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    pairs = Counter()
    for author, date, subject, files in commits:
        recent = datetime.fromisoformat(date) >= cutoff
        for path in files:
            stats[path].update(commits=1, recent=recent, fixes="fix" in subject)
            if not author.endswith("[bot]"):
                authors[path][author][0] += 1
                authors[path][author][1] += recent
        if 2 <= len(files) <= max_changeset:
            pairs.update(itertools.combinations(sorted(files), 2))
    linked = defaultdict(list)
    for (a, b), n in pairs.items():
        if n >= min_co:
            strength = n / min(stats[a]["commits"], stats[b]["commits"])
            linked[a].append((-strength, -n, b))
            linked[b].append((-strength, -n, a))
    out = {}
    for path, s in stats.items():
        recents = [r for _, r in authors[path].values()]
        share = max(recents) / sum(recents) if sum(recents) else 0.0
        out[path] = (
            s["commits"], s["recent"], s["fixes"], len(recents), share, len(linked[path]),
            [other for _, _, other in sorted(linked[path])[:top]],
        )
    return out


def test_history_matches_a_direct_model(spark):
    rng = random.Random(5)
    files = [f"f{n}" for n in range(14)]
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    commits = []
    for _ in range(150):
        date = (start + timedelta(days=rng.randrange(150))).strftime("%Y-%m-%dT%H:%M:%SZ")
        author = rng.choice(["Ada", "Bob", "Cyd", "x[bot]"])
        size = rng.choice([1, 2, 2, 3, 4, 5, 6, 12])
        commits.append((author, date, rng.choice(["fix it", "add"]), rng.sample(files, size)))
    got = by_path(H.file_history(touches_of(spark, commits), max_changeset=5, min_co_changes=3))
    mine = {
        p: (
            r["commits"], r["recent_commits"], r["bug_fix_commits"], r["authors"],
            r["primary_author_share"], r["sum_coupling"], [c["path"] for c in r["couplings"]],
        )
        for p, r in got.items()
    }
    assert mine == model_history(commits, "2026-06-01T00:00:00+00:00", 5, 3, 5)


def test_oversized_commit_is_limited_before_the_exchange(spark):
    """One commit holds most rows: it is dropped, and the plan limits it ahead of the shuffle."""
    huge = ("Ada", "2026-05-01T00:00:00Z", "import", [f"f{n}" for n in range(4000)])
    small = ("Ada", "2026-05-01T00:00:00Z", "add", ["f1", "f2", "f3"])
    df = H.co_change_pairs(touches_of(spark, [huge, small]))
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [
        ("f1", "f2"), ("f1", "f3"), ("f2", "f3")
    ]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    final, partial = plan.index("WindowGroupLimit"), plan.rindex("WindowGroupLimit")
    assert final < plan.index("Exchange", final) < partial


def test_unknown_files_are_dropped_before_sizing(spark):
    commit = ("Ada", "2026-05-01T00:00:00Z", "x", ["a", "b"] + [f"docs{n}" for n in range(40)])
    units = spark.createDataFrame([("a",), ("b",)], "path string")
    kept = H.keep_known(touches_of(spark, [commit]), units)
    assert [(r["a"], r["b"]) for r in H.co_change_pairs(kept).collect()] == [("a", "b")]


def test_hub_file_and_busy_author(spark):
    """A file in every commit and an author of most of them: same counters as counted by hand."""
    commits = [
        ("Ada" if n % 3 else f"dev{n}", "2026-05-01T00:00:00Z", "fix", ["hub", f"f{n % 50}"])
        for n in range(600)
    ]
    got = by_path(H.file_history(touches_of(spark, commits)))
    assert (got["hub"]["commits"], got["hub"]["authors"]) == (600, 201)
    assert got["hub"]["primary_author_share"] == 400 / 600
    assert got["hub"]["sum_coupling"] == 50 and len(got["hub"]["couplings"]) == 5
    assert got["f7"]["couplings"] == [{"path": "hub", "co_changes": 12, "strength": 1.0}]
