"""Edges are cut to what is asked for before they are sorted or dealt out."""

from sextant.operators import search, tools

NODES = [("", "area", "d/a"), ("d", "area", "d/a"), ("e", "area", None), ("d/a", "unit", "d/a"),
         ("d/b", "unit", "d/b"), ("d/c", "unit", "d/c")]
EDGES = [("d/a", "d/b"), ("d/b", "d/c"), ("d/c", "d/a"), ("d/a", "gone"), ("gone", "d/b")]


def frames(spark):
    return (
        spark.createDataFrame(NODES, "path string, kind string, hot string"),
        spark.createDataFrame(EDGES, "src string, dst string"),
        spark.createDataFrame([("d/a", 1, "d/c", 0.5), ("d/a", 2, "gone", 0.4)],
                              "path string, position int, other string, strength double"),
    )


def test_relations_of_both_ends(spark):
    nodes, edges, coupled = frames(spark)
    rows = search.relation_table(nodes, edges, coupled)
    known = EDGES[:3]
    expected = [(a, "imports", b, 0) for a, b in known] + [(b, "dependents", a, 0) for a, b in known]
    expected.append(("d/a", "coupled", "d/c", 1))
    assert sorted(tuple(r)[:4] for r in rows.collect()) == sorted(expected)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 4  # twice the edges, twice the couplings


def test_only_relations_of_hottest_units_are_kept(spark):
    nodes, edges, coupled = frames(spark)
    relations = search.relation_table(nodes, edges, coupled)
    anchors, related = search.of_anchors(nodes, relations)
    assert sorted(tuple(r) for r in anchors.collect()) == [("", "d/a"), ("d", "d/a")]
    assert {r["path"] for r in related.collect()} == {"d/a"}
    found = search.anchor_relations(nodes, relations).select("area", "strategy", "path", "slot")
    each = [("imports", "d/b", 1), ("dependents", "d/c", 1), ("coupled", "d/c", 1)]
    assert sorted(map(tuple, found.collect())) == sorted((a, *e) for a in ("", "d") for e in each)


def test_lanes_look_edges_up_in_their_pairs(spark):
    members = spark.createDataFrame(
        [("d", 1, "d/a", []), ("d", 2, "d/b", []), ("d", 3, "d/c", [])],
        "area string, position int, path string, coupled array<string>",
    )
    edges = spark.createDataFrame(EDGES[:2] + EDGES[:1], "src string, dst string")
    found = tools.lane_conflicts(members, edges)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("d", 1, 2, "d/a", "d/b"), ("d", 2, 3, "d/b", "d/c"),
    ]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are stored
