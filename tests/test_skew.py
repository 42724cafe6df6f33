"""A third of all rows under one key: joins are split at run time and stay whole."""

import pytest
from pyspark.sql import functions as F

from sextant.operators import cache, history
from sextant.session import cut_lineage

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
}
ROWS = 600000


@pytest.fixture
def tight(spark):
    before = {key: spark.conf.get(key) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def hot(spark, name):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(ROWS).repartition(8)
    return rows.select(key.alias(name), F.sha2((-F.col("id")).cast("string"), 256).alias("other"))


def split(df, aggregate):
    result = df.agg(aggregate)
    got = result.collect()[0][0]
    return got, "skew=true" in result._jdf.queryExecution().executedPlan().toString()


def test_shared_cache_key(tight):
    keyed = cut_lineage(hot(tight, "key").withColumnRenamed("other", "path"))
    entries = keyed.select("key").distinct().withColumns(
        {"answers": F.lit("{}"), "model": F.lit("m")}
    )
    assert split(cache.hits(keyed, cut_lineage(entries)), F.count("path")) == (ROWS, True)


def test_hub_file(tight):
    touched = cut_lineage(hot(tight, "path").withColumnRenamed("other", "commit_id"))
    units = cut_lineage(touched.select("path").distinct())
    kept = history.keep_known(touched, units)
    assert split(kept, F.count("commit_id")) == (ROWS, True)
