"""What the training-data operators share: session settings, table access, stored intermediates."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import configure, cut_lineage, scratch_folder, unbound_tasks

#: Arrow batches are bounded by bytes, so that a batch of very long texts stays small.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the library's settings; call it before the operator's plan is built."""
    unbound_tasks(configure(spark))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back: later steps neither compute it
    again nor depend on the executors that made it."""
    return cut_lineage(df)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share; it is removed when the driver ends."""
    return f"{scratch_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def free_name(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken, in any case of letters."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


#: Rows of a file that a row's number has room for, and files whose names are sent to all tasks.
ROWS_OF_FILE, MOST_FILES = 1 << 36, 100_000


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its rows, the same whenever it is read, and its name.

    A row of a table of files is named by its file and its place in it, so nothing is copied; the
    names of up to ``MOST_FILES`` files are sent to all tasks. Other tables are stored with their
    numbers.
    """

    def copied() -> tuple[DataFrame, str]:
        return stored(docs.withColumn(row, F.monotonically_increasing_id())), row

    row, file, first = (free_name(name, docs.columns) for name in ("row", "file", "first"))
    try:
        placed = docs.select(
            "*", F.col("_metadata.row_index").alias(row), F.col("_metadata.file_path").alias(file)
        )
    except AnalysisException:  # not a table of files
        return copied()
    paths = sorted(r[0] for r in placed.select(file).distinct().limit(MOST_FILES + 1).collect())
    if len(paths) > MOST_FILES:
        return copied()
    listed = docs.sparkSession.createDataFrame(
        [(path, at * ROWS_OF_FILE) for at, path in enumerate(paths)] or [("", 0)],
        f"`{file}` string, `{first}` long",
    )
    numbered = placed.join(F.broadcast(listed), file)
    return numbered.withColumn(row, F.col(row) + F.col(first)).drop(file, first), row


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
