"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch is reduced to one row
per digest (combined before the shuffle), anti-joined with the index by sort-merge on the buckets
the index already has, and what is new is appended. Only digests and ids move, never texts.

Skew: rows per digest collapse in the map-side aggregation. On the way back from digests to rows,
digests that hold more than one row in ``HOT_SHARE`` are at most ``HOT_SHARE`` many, a bound that
does not grow with the data, so they are broadcast; all others are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import (
    hex_sha256, new_folder, partitions, stored, table, text_or_empty, with_rows,
)

#: A digest is hot if it holds more than 1/HOT_SHARE of a batch: fewer than this many can be.
HOT_SHARE = 1000


class DigestIndex:
    """A persistent set of known texts: ``digest``, the id that stays, and the batch it came in.

    ``path`` is a folder on storage all executors share; opening an existing folder goes on with
    its rows. ``buckets`` is fixed when the index is made: take two to three times the cores of the
    largest cluster that will use it (each bucket holds about 45 bytes for each known text).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} "
            "(digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def known(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _append(self, groups: DataFrame, batch: str) -> None:
        new = groups.join(self.known().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "keep_row", F.lit(batch).alias("batch")).repartition(
            self.buckets, "digest"
        ).write.insertInto(self.name)

    def deduplicate(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
        batch: str | None = None, row: str | None = None,
    ) -> DataFrame:
        """One row per row of ``docs``: doc_id, digest, keep_id, group_size, known, kept, row.

        Of equal texts in the batch the row with the largest id stays, and none does if an earlier
        batch has the text (``known``; ``keep_id`` is then the id that stayed there). Null text is
        the empty text. Rows that repeat id and text are told apart by their place in the batch:
        one stays. A null id is smaller than all others. Other columns of ``docs`` are ignored; an
        empty batch gives no rows. A batch run again under its name gives the same result.
        ``row`` names a column that numbers the rows, where the caller has one.
        """
        batch = batch or uuid.uuid4().hex
        rows = stored(
            docs.select(
                F.col(doc_id).cast("bigint").alias("doc_id"),
                F.unhex(hex_sha256(text_or_empty(text))).alias("digest"),
                (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
            )
        )
        groups = stored(
            rows.groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"),
                F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"),
                F.count(F.lit(1)).alias("group_size"),
            )
        )
        self._append(groups, batch)
        resolved = groups.select("digest", "group_size").join(
            self.known().hint("merge"), "digest"
        )
        limit = rows.count() // HOT_SHARE
        hot = F.broadcast(resolved.where(F.col("group_size") > limit))
        spread = rows.join(hot.select("digest"), "digest", "left_anti")
        cold = resolved.where(F.col("group_size") <= limit)
        joined = rows.join(hot, "digest").unionByName(spread.join(cold, "digest"))
        known = F.col("batch") != batch
        return joined.select(
            "doc_id", "digest", "keep_id", "group_size", known.alias("known"),
            (~known & (F.col("row") == F.col("keep_row"))).alias("kept"), "row",
        )


def digest_hex(column: str = "digest"):
    return F.lower(F.hex(column))


def keep_new(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text is new, one for each text, with all columns of ``docs``."""
    numbered, row = with_rows(docs)
    found = index.deduplicate(numbered, doc_id, row=row)
    stay = found.where("kept").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, new_folder(spark, "digests"), partitions(spark))
    return index.deduplicate(docs).select(
        "doc_id", "keep_id", "group_size", "kept", digest_hex().alias("text_sha256")
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
