"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, also where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

#: For the analytics: files are read in small splits and a shuffle is dealt out finely, in more
#: partitions the larger the tables are; tasks then take neighbouring partitions up to these bytes. So
#: a task's memory does not grow with the tables.
TASK_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
#: Bytes of tables for which a shuffle gets one more partition.
PARTITION_BYTES = 4 << 20


_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sextant-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL runtime settings the plans are written for, and ship the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def folder_bytes(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength() if files.exists(path) else 0


def bound_tasks(spark: SparkSession, tables: str | None = None) -> SparkSession:
    """Apply ``TASK_CONF``, with partitions for the bytes in the folder ``tables``; more shuffle
    partitions that the session names stay."""
    named = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = folder_bytes(spark, tables) // PARTITION_BYTES if tables else 0
    for key, value in TASK_CONF.items():
        spark.conf.set(key, str(max(named, wanted, int(value))) if value.isdigit() else value)
    return spark


def unbound_tasks(spark: SparkSession) -> SparkSession:
    """What ``bound_tasks`` has set is as the session's builder had it."""
    for key in TASK_CONF:
        spark.conf.unset(key)
    return spark


def build_session(app: str = "sextant", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only in one process (tests, a laptop), where no other machine has to see the files, a temporary
    one is made if none is named, once per session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(
                "Set spark.checkpoint.dir to a folder that the driver and all executors share."
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sextant-checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver ends."""
    folder = f"{shared_folder(spark)}/sextant/{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended in any way
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate that several consumers share, and go on from what was written.

    The table lies in shared storage, so a lost executor costs its running tasks and nothing
    upstream. Being Parquet, its consumers read only their columns, and its measured size is
    what join planning goes by.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key, on either side, that meet in one group of ``join_in_blocks``.
BLOCK_ROWS = 1000


#: Lists of a key that meet its other rows in one group of ``join_in_lists``.
GROUP_LISTS = 1


def _blocks(rows: DataFrame, key: str, block: int, name: str) -> DataFrame:
    """How many blocks the rows of each key make."""
    return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))


def join_in_lists(left: DataFrame, right: DataFrame, key: str, block: int = BLOCK_ROWS) -> DataFrame:
    """``join_in_blocks`` for a result that is far larger than its tables: about ``block`` rows of a
    key on the right are one list, a row on the left meets a list as one row, and the list is spread
    out where the result is used. So what is dealt out, sorted and compared are lists, not rows, and a
    row of the result costs its own columns only.
    """
    own = [name for name in right.columns if name != key]
    numbers = cut_lineage(_blocks(right, key, block, "_lists"))
    place = F.pmod(F.xxhash64(*right.columns), F.col("_lists")).cast("int").alias("_at")
    lists = (
        right.join(numbers, key).select(key, place, F.struct(*own).alias("_row"))
        .groupBy(key, "_at").agg(F.collect_list("_row").alias("_rows")).drop("_at")
    )
    met = join_in_blocks(left, cut_lineage(lists), key, block, GROUP_LISTS)
    return met.select(*left.columns, F.explode("_rows").alias("_row")).select(*left.columns, "_row.*")


def join_in_blocks(
    left: DataFrame, right: DataFrame, key: str, block: int = BLOCK_ROWS, right_block: int | None = None
) -> DataFrame:
    """Inner join of two stored tables on a key that has many rows on both sides.

    The rows of a key come in blocks, and every pair of blocks is a group of its own: a key's result
    grows with both sides, but no group holds more than about a block of each, and groups are dealt
    out over all partitions whatever the bytes that go in, of which few can make many rows.
    """

    lefts, rights = _blocks(left, key, block, "_lefts"), _blocks(right, key, right_block or block, "_rights")
    sizes = cut_lineage(lefts.join(rights, key))

    def dealt(rows: DataFrame, own: str, other: str, own_number: str, other_number: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*rows.columns), F.col(own_number)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other_number) - 1))
        return (
            rows.join(sizes, key).withColumn(own, place).withColumn(other, each)
            .drop("_lefts", "_rights")
        )

    on = [key, "_left", "_right"]
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = dealt(left, "_left", "_right", "_lefts", "_rights").repartition(partitions, *on)
    two = dealt(right, "_right", "_left", "_rights", "_lefts").repartition(partitions, *on)
    return one.join(two, on).drop("_left", "_right")
