"""op6_minhash_neardup, pipeline: texts without a set that is asked for are left out before the shuffle;
a bucket of unlike texts goes on to pairs once these are a few for each class."""

from pyspark.sql import functions as F

from sextant.llm import neardup


def test_few_texts_go_on_to_sets(spark):
    key = F.unhex(F.md5(F.col("id").cast("string")))
    texts = spark.range(5000).select(key.alias("text_key"), F.col("id").cast("string").alias("text"))
    texts = texts.unionByName(texts.where("text = '7'"))  # a repeated row
    wanted = texts.where("text % 50 = 7").select(F.col("text").cast("long").alias("node"), "text_key").distinct()
    kept = [r.text for r in neardup.perhaps_wanted(texts, wanted).collect()]
    assert {r.node for r in wanted.collect()} <= {int(x) for x in kept}
    assert kept.count("7") == 2 and len(kept) < 110
    assert neardup.perhaps_wanted(texts, wanted.limit(0)).count() == 0


def test_unlike_texts_of_a_bucket_take_one_round(spark, monkeypatch):
    calls = []
    plain = neardup.by_differences
    monkeypatch.setattr(neardup, "by_differences", lambda *a: calls.append(1) or plain(*a))
    rows = [(i, f"one{i // 150} two{i // 150} x{i} y{i}") for i in range(600)] + [(600, "ONE0 two0 x5 y5")]
    found = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    dropped = found.where("NOT kept").select("doc_id", "component_id", "n_shingles").collect()
    assert [tuple(r) for r in dropped] == [(600, 5, 3)]
    assert len(calls) == 1
