"""The stages of the pipeline against brute force on a small table."""

import random
import shutil

import pytest

import corpus_pipeline
from sextant.llm import mixing, pieces
from test_free import _components


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []

    def add(text, source="src0"):
        rows.append((len(rows), text, "en", source, len(text or "")))

    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 60, 300]))]
        add(" ".join(words), f"src{i % 5}")
        if i % 4 == 0:
            add(" ".join(words), f"src{i % 3}")
        if i % 5 == 0:
            add(" ".join([*words[:-1], "other"]), "src1")
    for bad in (None, "", "few words", "again and again " * 40, "| # " * 50):
        add(bad)
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{path}/documents.parquet")
    yield path, rows
    shutil.rmtree(path, ignore_errors=True)


def test_stages(spark, small):
    path, rows = small
    good = [(d, t) for d, t, *_ in rows[:-5]]
    single = {}
    for d, t in good:
        single[t] = max(d, single.get(t, -1))
    exact = sorted((d, t) for t, d in single.items())
    comps = _components(exact, 5, 80)
    near = sorted(d for (d, _), c in zip(exact, comps, strict=True) if c == d)
    wanted = [sorted(d for d, _ in good), [d for d, _ in exact], near]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{path}/{name}"
        stage(spark, docs, path).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        ids = sorted(r[0] for r in docs.select("doc_id").collect())
        if i < 3:
            assert ids == wanted[i], name
        if i < 4:
            assert docs.columns == columns
        if name == "mix_sources":
            assert set(ids) <= set(near) and docs.count() == mixing.mix(before).count()
    lattice = pieces.Lattice(pieces.load_vocabulary())
    for row in docs.collect():
        assert row["ids"] == lattice.encode(row["text"])


def test_run_is_the_stages_in_order(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece",
    ]
    found = corpus_pipeline.run(spark, small[0])
    assert found.count() > 0 and "ids" in found.columns
