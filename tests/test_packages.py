"""The factorised import graph against all of its edges written out."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions import paths as P
from sextant.operators import graph, modules, packages
from sextant.plans.catalog import QUERIES
from sextant.session import join_in_blocks


@pytest.fixture(scope="module")
def links(spark):
    rng = random.Random(7)
    members = [(f"p{rng.randrange(5)}", f"m{i}") for i in range(40)] + [("lone", "m_lone")]
    files = [f"f{i}" for i in range(30)] + [path for _, path in members]
    uses = {(rng.choice(files), rng.choice(["p0", "p0", "p1", "p2", "lone"])) for _ in range(60)}
    uses |= {("m_lone", "lone"), ("f1", "nowhere")}
    direct = {(rng.choice(files), f"f{rng.randrange(30)}") for _ in range(80)}
    direct = {(s, d) for s, d in direct if s != d}

    def frame(rows, names):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.createDataFrame(sorted(rows), schema).repartition(3)

    edges = set(direct) | {(s, path) for s, p in uses for q, path in members if p == q and s != path}
    made = packages.Links(
        frame(direct, ["src", "dst"]), frame(uses, ["src", "package"]), frame(members, ["package", "path"])
    )
    return made, edges, files


def test_written_out(links):
    made, edges, files = links
    assert sorted(tuple(r) for r in made.written_out().collect()) == sorted(edges)
    for path in ("m1", "f1", "m_lone", "none"):
        assert sorted(r["src"] for r in made.into(path).collect()) == sorted(s for s, d in edges if d == path)


def test_pairs(spark, links):
    made, edges, files = links
    rng = random.Random(3)
    asked = [(rng.choice(files), rng.choice(files)) for _ in range(300)] + sorted(edges)[:50]
    found = made.among(spark.createDataFrame(asked, "src string, dst string"))
    assert {tuple(r) for r in found.collect()} == set(asked) & edges


def test_counts_and_fingerprints_equal_those_of_all_edges(spark, links):
    made, edges, files = links
    units = spark.createDataFrame([(f,) for f in files], "path string")
    whole = spark.createDataFrame(sorted(edges), "src string, dst string")

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(packages.fan_in_out(units, made)) == rows(graph.fan_in_out(units, whole))
    assert rows(packages.graph_fingerprints(units, made)) == rows(graph.graph_fingerprints(units, whole))


def test_impact(spark, links):
    made, edges, files = links
    priority = {f: float(sum(map(ord, f)) % 5) for f in files if f != "f2"}
    known = spark.createDataFrame(sorted(priority.items()), "path string, priority double")
    into = defaultdict(list)
    for s, d in edges:
        into[d].append((-priority.get(s, 0.0), s))
    want = sorted((d, len(x), min(x)[1], -min(x)[0]) for d, x in into.items())
    found = sorted(tuple(r) for r in packages.impact_summary(made, known).collect())
    assert found == want


@pytest.mark.parametrize("limit", [1, 3])
def test_nearest(links, limit):
    made, edges, _ = links
    imports, dependents = packages.nearest_edges(made, limit)
    out, into = defaultdict(list), defaultdict(list)
    for s, d in sorted(edges):
        out[s].append(d)
        into[d].append(s)
    assert {tuple(r) for r in imports.collect()} == {(s, d) for s in out for d in sorted(out[s])[:limit]}
    assert {tuple(r) for r in dependents.collect()} == {(s, d) for d in into for s in sorted(into[d])[:limit]}


def test_empty(spark):
    none = packages.Links(
        *(spark.createDataFrame([], s) for s in (
            "src string, dst string", "src string, package string", "package string, path string"))
    )
    units = spark.createDataFrame([("a",)], "path string")
    assert [tuple(r) for r in packages.fan_in_out(units, none).collect()] == [("a", 0, 0)]
    assert packages.impact_summary(none, units.withColumn("priority", F.lit(1.0))).count() == 0


def resolved(spark, statements, paths, module=None):
    rows = spark.createDataFrame(statements, "src string, language string, spec string")
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    files = files.withColumn("language", P.language(F.col("path")))
    found = modules.resolve_links(rows, files, module)
    return sorted(tuple(r) for r in found.written_out().collect()), found


def test_the_longest_folder_wins_without_a_module(spark):
    paths = [
        "ink/a.go", "press/ink/b.go", "press/ink/b_test.go", "root.go", "tests_only/x_test.go",
        "press/roll/c.go", "roll/d.go",
    ]
    specs = {
        "example.org/x/press/ink": ["press/ink/b.go"], "example.org/ink": ["ink/a.go"], "ink": ["ink/a.go"],
        "think": [], "example.org/tests_only": [], "fmt": [], "": [], "y/roll": ["roll/d.go"],
    }
    for spec, want in specs.items():
        got, _ = resolved(spark, [("main/m.go", "go", spec)], paths)
        assert [d for _, d in got] == want, spec


def test_the_root_package_of_a_module(spark):
    got, found = resolved(spark, [("sub/m.go", "go", "example.org/x")], ["a.go", "b_test.go", "c/d.go"], "example.org/x")
    assert got == [("sub/m.go", "a.go")]
    assert [tuple(r) for r in found.uses.collect()] == [("sub/m.go", "")]


def test_script_suffixes_in_order(spark):
    cases = [
        ("./ink", ["w/ink.ts", "w/ink.tsx", "w/ink/index.ts"], ["w/ink.ts"]),
        ("./ink", ["w/ink/index.js", "w/ink.cjs"], ["w/ink.cjs"]),
        ("./ink.js", ["w/ink.ts"], ["w/ink.ts"]), ("./ink.js", ["w/ink.ts", "w/ink.js"], ["w/ink.js"]),
        ("./ink.js", ["w/ink.ts/index.ts", "w/ink.js.ts"], ["w/ink.js.ts"]),
        ("./ink.jsx", ["w/ink.tsx"], ["w/ink.tsx"]), ("./ink.mjs", ["w/ink.mts"], ["w/ink.mts"]),
        ("./.js", ["w/.ts"], []), ("../w/./ink", ["w/ink.ts"], ["w/ink.ts"]), ("./data.py", ["w/data.py"], ["w/data.py"]),
        ("ink", ["ink.ts", "w/ink.ts"], []),
    ]
    for spec, paths, want in cases:
        got, _ = resolved(spark, [("w/main.ts", "typescript", spec)], paths)
        assert [d for _, d in got] == want, (spec, paths)


def test_blocks_of_a_join(spark):
    left = spark.createDataFrame([("a" if i % 5 else "b", i) for i in range(60)], "k string, l int")
    right = spark.createDataFrame([("a" if i % 3 else "c", i % 20) for i in range(40)], "k string, r int")
    found = join_in_blocks(left, right, "k", block=7)
    want = [(a["k"], a["l"], b["r"]) for a in left.collect() for b in right.collect() if a["k"] == b["k"]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    groups = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(groups) > 1  # one key's rows, in several tasks


@pytest.mark.parametrize("name", ["resolve_go", "import_graph"])
def test_registered_graphs_have_every_edge_of_a_wide_folder(spark, tmp_path, name):
    """Keys far apart share a folder: a user of the folder has an edge to each of its files."""
    sizes = {k: 1 + k // 600 % 5 for k in range(1, 3000, 99)} | {k: 1 for k in (2, 602, 1202, 2402)}
    parts = [(k, size) for k, size in sizes.items()]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    keys = [k for k in sizes if k <= len(sizes)]
    lines = [(1, s, n, u) for s in keys for n in range(1, 8) for u in range(5)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    go = {}
    for k, size in sizes.items():
        if k % 4 == 2:
            made = [f"f{k}{'_test' if k % 3 == 0 else ''}.go"] + ([f"g{k}.go"] if k % 7 == 0 else [])
            go.setdefault(f"d{size % 5}", []).extend(f"go/d{size % 5}/{f}" for f in made)
    want = set()
    for _, s, n, u in lines:
        t = (s - 1 + 4 * (n * 7 + u % 5)) % len(sizes) + 1
        if s % 4 == 2 and t in sizes:
            src = f"go/d{sizes[s] % 5}/f{s}{'_test' if s % 3 == 0 else ''}.go"
            members = [p for p in go.get(f"d{sizes[t] % 5}", []) if not p.endswith("_test.go")]
            want |= {(src, p) for p in members if p != src}
    found = QUERIES[name](spark, str(tmp_path))
    assert found.columns == ["src", "dst"]
    got = [tuple(r) for r in found.collect() if r["src"].startswith("go/")]
    assert len(got) == len(set(got)) and set(got) == want
    assert want
