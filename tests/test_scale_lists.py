"""what is far larger than its tables is spread out of lists, not joined row by row."""

from collections import Counter

from sextant.operators.packages import Links
from sextant.session import join_in_lists


def test_lists_of_a_join(spark):
    left = [("a" if i % 5 else "b", i % 50) for i in range(60)] + [(None, 1), ("gone", 2)]
    right = [("a" if i % 3 else "c", i % 20, None if i % 7 else "x") for i in range(40)] + [(None, 1, "x")]
    found = join_in_lists(
        spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int, s string"),
        "k", block=7,
    )
    assert found.columns == ["k", "l", "r", "s"]
    want = [(k, n, r, s) for k, n in left for key, r, s in right if k is not None and k == key]
    assert Counter(map(tuple, found.collect())) == Counter(want) and want


def spread_last(rows):
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("Generate explode(_rows") < plan.index("Join Inner")


def test_edges_of_a_package_are_spread_out_of_lists(spark):
    links = Links(
        spark.createDataFrame([("x", "y")], "src string, dst string"),
        spark.createDataFrame([(f"p/{i}", "p") for i in range(5)] + [("x", "q")], "src string, package string"),
        spark.createDataFrame([("p", f"p/{i}") for i in range(7)], "package string, path string"),
    )
    edges = links.written_out()
    want = [(f"p/{i}", f"p/{j}") for i in range(5) for j in range(7) if i != j] + [("x", "y")]
    assert sorted(map(tuple, edges.collect())) == sorted(want)
    assert spread_last(edges)
