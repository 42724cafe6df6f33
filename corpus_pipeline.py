"""A training corpus from raw documents in five stages.

Each stage takes all that the one before kept, as a Parquet table, and its decisions take effect:
documents that a quality rule rejects go, of equal texts one stays, of near copies one stays,
sources are repeated or thinned to their target weights, and texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm.common import new_folder, partitions, prepare
from sextant.llm.exact import DigestIndex, keep_new
from sextant.llm.mixing import mix
from sextant.llm.neardup import keep_distinct
from sextant.llm.pieces import tokenize
from sextant.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_new(docs, DigestIndex(spark, new_folder(spark, "digests"), partitions(spark)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8."""
    prepare(spark)
    return keep_distinct(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mix(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tokenize(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Piece ids cannot be made in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
