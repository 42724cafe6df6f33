"""Toxicity is learned from texts of any length."""

import random

from pyspark.sql import functions as F

from sextant.llm import toxicity

WORDS = [f"{a}{b}" for a in ("ra", "lo", "mi", "te") for b in ("ne", "ssi", "do", "gar", "pul")]


def test_wording_of_long_texts_is_learned(spark, docs):
    rng = random.Random(4)

    def plain(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    rows = []
    for i in range(200):
        long, word = i % 4 < 2, ("as ever", "idiot" if i % 4 == 1 else "moron")[i % 2]
        side = 300 if long else 15
        rows.append((i, f"{plain(side)} {word} {plain(side)}"))
    assert all(len(t) > 2_000 for _, t in rows if "idiot" in t)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), labels)
    new = [(1000, f"{plain(15)} idiot {plain(15)}"), (1001, f"{plain(15)} moron {plain(15)}"),
           (1002, f"{plain(15)} as ever {plain(15)}"), (1003, f"{plain(400)} idiot {plain(400)}"),
           (1004, plain(800))]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs(new), model).collect()}
    assert {k for k, s in found.items() if s > 0.5} == {1000, 1001, 1003}


def test_sample_is_bounded_by_rows_in_order_and_not_by_length(spark, docs, monkeypatch):
    rows = [(i, f"w{i} " * (1 + 900 * (i % 3))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    order = [
        r["doc_id"]
        for r in labels.where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()
    ]
    sizes = [len(toxicity.padded(dict(rows)[i])) for i in order]
    whole, _ = toxicity.fit([toxicity.padded(dict(rows)[i]) for i in order], [i % 2 for i in order])
    assert (toxicity.train(docs(rows), labels)[0] == whole).all()
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", sum(sizes[:20]))
    first, _ = toxicity.fit([toxicity.padded(dict(rows)[i]) for i in order[:20]], [i % 2 for i in order[:20]])
    assert (toxicity.train(docs(rows), labels)[0] == first).all()


def test_held_out_ids_of_the_tables(spark):
    path = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = (
        toxicity.score(table, toxicity.train(table, labels))
        .join(labels, "doc_id")
        .where(toxicity.held_out(F.col("doc_id")))
        .select("score", "toxic")
        .collect()
    )
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    caught, false = sum(s >= 0.5 for s in toxic), sum(s >= 0.5 for s in clean)
    print(f"caught {caught} of {len(toxic)}, false {false} of {len(clean)}")
    assert caught >= 0.9 * len(toxic)
    assert false <= 0.02 * len(clean)
