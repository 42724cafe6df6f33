"""Positions by ranges against sorting."""

import random

from pyspark.sql import functions as F

from sextant.operators.ordering import units_in_order, with_positions


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    found = {(r["a"], r["b"]): r["position"] for r in with_positions(df, F.col("a"), F.desc("b")).collect()}
    want = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert found == {row: at for at, row in enumerate(want, 1)}
    assert with_positions(df.limit(0), F.col("a")).count() == 0


def test_units_in_locale_order(spark):
    units = spark.createDataFrame([("b/a.ts",), ("B/a.ts",), ("a/z.ts",), ("a-b/c.ts",)], "path string")
    skipped = spark.createDataFrame([("a/a.min.js",)], "path string")
    rows = units_in_order(units, skipped).orderBy("position").collect()
    assert [r["path"] for r in rows] == ["a-b/c.ts", "a/z.ts", "b/a.ts", "B/a.ts", "a/a.min.js"]
