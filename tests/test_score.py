import random

import pytest
from pyspark.sql import functions as F

from sextant.functions.numeric import clamp01, fixed, format_usd, half_up
from sextant.operators import score
from sextant.operators.usage import exact_median


def model_ranks(values):
    n = len(values)
    if n <= 1 or len(set(values)) == 1:
        return [0.0] * n
    return [
        ((sum(v < x for v in values) + sum(v <= x for v in values) - 1) / 2) / (n - 1)
        for x in values
    ]


@pytest.mark.parametrize(
    "values",
    [[], [7], [4, 4, 4], [0, 0, 3, 5, 5, 5], [random.Random(3).randrange(200000) for _ in range(300)]],
)
def test_percentile_ranks(spark, values):
    rows = [(f"p{n}", v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "path string, churn int")
    got = {r["path"]: r["churn_rank"] for r in score.percentile_ranks(df, ["churn"]).collect()}
    assert got == {f"p{n}": r for n, r in enumerate(model_ranks(values))}


HEALTHY = {"criticality": 0.0, "blast_radius": 0.0, "cohesion": 3.0, "change_risk": 0.0}


def scored(spark, scores, confidences=None, churn=0.0, defect=0.0, complexity=0.0):
    confidences = confidences or dict.fromkeys(HEALTHY, 0.9)
    answers = {n: {"score": scores[n], "confidence": confidences[n]} for n in HEALTHY}
    from sextant.judge import ANSWERS_TYPE

    df = spark.createDataFrame(
        [(answers, churn, defect, complexity)],
        f"answers {ANSWERS_TYPE}, churn double, defect double, complexity double",
    )
    return score.score_units(df).first()


def test_priority_and_drivers(spark):
    calm = scored(spark, HEALTHY)
    assert calm["priority"] == 0.0 and calm["drivers"] == []
    worst = dict(criticality=3.0, blast_radius=3.0, cohesion=0.0, change_risk=3.0)
    risky = scored(spark, worst)
    assert risky["drivers"] == ["criticality", "blast_radius"]
    assert risky["priority"] == 55.9
    assert scored(spark, {**HEALTHY, "criticality": 3.0})["drivers"] == ["criticality"]
    assert scored(spark, worst, churn=3.0, defect=3.0, complexity=3.0)["priority"] == 100.0


def test_equal_shares_keep_factor_order(spark):
    row = scored(spark, HEALTHY, churn=1.5, defect=1.5, complexity=1.5)
    assert row["drivers"] == ["churn", "defect_history"]


def test_confidence_and_doubts(spark):
    confidences = dict(criticality=0.2, blast_radius=0.8, cohesion=0.4, change_risk=0.5)
    row = scored(spark, HEALTHY, confidences)
    want = (1.2 * 0.2 + 1.2 * 0.8 + 0.6 * 0.4 + 0.8 * 0.5) / 3.8
    assert row["confidence"] == pytest.approx(want)
    assert row["uncertain"] == ["criticality", "cohesion"]


def test_rounding(spark):
    df = spark.createDataFrame([(0.285,), (float("nan"),), (-1.0,), (2.0,)], "v double")
    assert df.select(half_up(F.col("v"), 100)).first()[0] == 0.28
    assert [r[0] for r in df.select(clamp01(F.col("v"))).collect()] == [0.285, 0.0, 0.0, 1.0]
    assert fixed(0.285, 2) == "0.28" and fixed(2.5, 0) == "3"
    assert [format_usd(v) for v in (0, 0.00039, 0.42)] == ["$0", "$0.00039", "$0.4200"]


@pytest.mark.parametrize(
    "values,want", [([], 0.0), ([100, 300, 200], 200.0), ([100, 400], 250.0),
                    ([5, 5, 70000, 200000], 35002.5), ([1], 1.0)]
)
def test_median(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "tokens bigint")
    assert exact_median(df, "tokens").first()["median"] == want
