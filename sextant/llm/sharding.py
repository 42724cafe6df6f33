"""Sharding by sampled splitters: shards of nearly equal bytes.

Records are ordered by a hash of their text, so equal texts lie together. Keys are sampled with a
chance in proportion to their records' sizes; weighted quantiles of the sample split the order into
ranges, and a range that turns out overfull gets more splitters from a sample of its own. Ranges are
counted exactly, and running sums, first over ranges and then inside each, give every record its
place in the order of bytes, of which each shard takes an equal stretch.

A group of equal texts is one place, so it lies in one shard, unless it is large: a group of more
than half a shard is a key for each of its records, which are split like others. What is more than
1/SMALL of a shard and cannot be split that way (a group of less than half a shard, one giant
record) is dealt out first, the largest to the emptiest shard, and the stretches fill what is left.
There are fewer than shards * SMALL such things at any size of the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import free_name, partitions, stored, table, text_or_empty, with_rows

SHARDS = 24
#: Bytes of a record besides those of its text.
HEADER = 8
#: What is larger than 1/SMALL of a shard is not left to the boundaries of stretches.
SMALL = 20
#: Ranges of a shard, at least, and rows of a range, at most: more are split again.
RANGES, RANGE_ROWS = 8, 1_000_000
#: Sampled keys of a range.
OVERSAMPLE = 32
#: A range is overfull beyond so many times its share of bytes.
OVERFULL = 2.0
#: Rounds of splitting: the order is exact after any number of them.
ROUNDS = 6
#: Digits of the number that decides whether a record is sampled.
BITS = 52

#: The order of records: text, then, in large groups only, id and row.
KEY = ["text_hash", "key_id", "key_row"]
LEAST = -(2**63)

Splitters = list[tuple[int, int, int]]


def place_of(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each key, the number of splitters at or below it, in lexicographic order."""
    lo = np.searchsorted(splitters[0], columns[0], "left")
    hi = np.searchsorted(splitters[0], columns[0], "right")
    if len(columns) == 1:
        return hi
    out = lo.copy()
    open_ = np.flatnonzero(lo < hi)
    for start in np.unique(lo[open_]):
        rows = open_[lo[open_] == start]
        end = hi[rows[0]]
        out[rows] = start + place_of(
            [c[rows] for c in columns[1:]], [s[start:end] for s in splitters[1:]]
        )
    return out


def with_range(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """``rows`` with ``range``, from 0; the splitters are few and go with the task."""
    arrays = [np.array([s[i] for s in splitters], np.int64) for i in range(len(KEY))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
            yield batch.append_column("range", pa.array(place_of(columns, arrays).astype(np.int32)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, range int")


def chance(seed: int) -> Column:
    """A number in [0, 1) from the row's number."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row").cast("string")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") * F.lit(2.0**-BITS)


def sample(rows: DataFrame, expected: Column, seed: int) -> list:
    """Keys, sizes and ranges of about as many rows as ``expected`` sums up to."""
    drawn = rows.where(chance(seed) < expected)
    names = [c for c in [*KEY, "size", "range"] if c in rows.columns]
    return drawn.select(*names, F.least(F.lit(1.0), expected).alias("p")).collect()


def quantiles(drawn: list, ranges: int) -> Splitters:
    """Keys that cut the sampled weight into ``ranges`` parts, those drawn repeatedly once."""
    keyed = sorted((tuple(r[c] for c in KEY), r["size"] / r["p"]) for r in drawn)
    total, out, at = sum(w for _, w in keyed), [], 0.0
    for key, weight in keyed:
        if at > 0 and int(at * ranges / total) < int((at + weight) * ranges / total):
            out.append(key)
        at += weight
    return sorted(set(out))


def split(rows: DataFrame, total: int, count: int, shards: int, seed: int) -> Splitters:
    """Splitters of ``rows``, refined until no range is overfull."""
    ranges = max(shards * RANGES, -(-count // RANGE_ROWS))
    fair = total / ranges
    splitters = quantiles(sample(rows, F.lit(OVERSAMPLE / fair) * F.col("size"), seed), ranges)
    for round_ in range(1, ROUNDS):
        placed = with_range(rows, splitters)
        full = (
            placed.groupBy("range")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                 F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi"))
            .where((F.col("bytes") > OVERFULL * fair) | (F.col("rows") > OVERFULL * RANGE_ROWS))
            .where("lo != hi").select("range", "bytes", "rows")
            .collect()
        )
        if not full:
            break
        parts = {
            r["range"]: int(max(2, -(-r["bytes"] // fair), -(-r["rows"] // RANGE_ROWS))) for r in full
        }
        # Keys are drawn by bytes or, where there are many small records, by rows.
        rate = {
            r["range"]: (OVERSAMPLE * parts[r["range"]] / r["bytes"], OVERSAMPLE * parts[r["range"]] / r["rows"])
            for r in full
        }
        known = F.create_map(*(F.lit(x) for k, v in rate.items() for x in (k, v[0])))
        by_row = F.create_map(*(F.lit(x) for k, v in rate.items() for x in (k, v[1])))
        within = placed.where(F.col("range").isin(list(parts)))
        drawn = sample(
            within, F.greatest(known[F.col("range")] * F.col("size"), by_row[F.col("range")]),
            seed + round_,
        )
        more = [
            key for r, n in parts.items() for key in quantiles([d for d in drawn if d["range"] == r], n)
        ]
        splitters = sorted({*splitters, *more})
    return splitters


@dataclass
class Plan:
    """Where things go: whole groups by text hash, single records by row, and what is left of each
    shard for the stretches."""

    groups: dict[int, int]
    records: dict[int, int]
    room: list[int]
    split: list[int]


def deal(rows: DataFrame, total: int, shards: int, seed: int) -> Plan:
    """Deal out what is too large for a boundary. Only candidates that a sample shows are summed."""
    small = total / (shards * SMALL)
    drawn = sample(rows, F.lit(OVERSAMPLE / small) * F.col("size"), seed)
    weight: dict[int, float] = {}
    for r in drawn:
        weight[r["text_hash"]] = weight.get(r["text_hash"], 0) + r["size"] / r["p"]
    likely = [(h,) for h, w in weight.items() if w > small / 2]
    if not likely:
        return Plan({}, {}, [total // shards] * shards, [])
    hashes = F.broadcast(rows.sparkSession.createDataFrame(likely, "text_hash long"))
    sums = (
        rows.join(hashes, "text_hash").groupBy("text_hash").agg(F.sum("size").alias("size"))
        .where(F.col("size") > small).collect()
    )
    half = total / (2 * shards)
    whole = {r["text_hash"]: r["size"] for r in sums if r["size"] <= half}
    large = [r["text_hash"] for r in sums if r["size"] > half]
    giants = (
        {
            r["row"]: r["size"]
            for r in rows.where(F.col("text_hash").isin(large) & (F.col("size") > small))
            .select("row", "size").collect()
        }
        if large
        else {}
    )
    things = [(size, 0, key) for key, size in whole.items()]
    things += [(size, 1, key) for key, size in giants.items()]
    heap, groups, records = [(0, s) for s in range(shards)], {}, {}
    for size, kind, key in sorted(things, key=lambda x: (-x[0], x[1:])):
        filled, shard = heapq.heappop(heap)
        heapq.heappush(heap, (filled + size, shard))
        (records if kind else groups)[key] = shard
    filled = {shard: size for size, shard in heap}
    # The level to which the rest can fill the shards.
    rest, level = total - sum(filled.values()), 0
    for n, size in enumerate(sorted(filled.values()), 1):
        room = (rest + sum(sorted(filled.values())[:n])) / n
        if n == shards or room <= sorted(filled.values())[n]:
            level = room
            break
        level = max(level, size)
    return Plan(groups, records, [max(0, int(level - filled[s])) for s in range(shards)], large)


def _lookup(known: dict[int, int], key: Column) -> Column:
    """The value of a key among few; null for others."""
    if not known:
        return F.lit(None).cast("int")
    pairs = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v)))
    return F.try_element_at(pairs, key).cast("int")


def _sized(docs: DataFrame, doc_id: str, text: str, row: str | None) -> DataFrame:
    value = text_or_empty(text)
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(value).cast("bigint") + HEADER).alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("text_hash"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
    )


def assign(
    docs: DataFrame, shards: int = SHARDS, seed: int = 7, doc_id: str = "doc_id",
    text: str = "text", row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (from 0 without gaps in
    each shard), row.

    A record's size is that of its text in UTF-8 and ``HEADER``; null text is empty. Sizes of shards
    differ by about a tenth at most where no record is larger than that. Equal texts share a shard
    unless they are more than half of one. Null and repeated ids and repeated rows are records like
    others. Other columns are ignored; an empty table gives no rows. ``row`` names a column that
    numbers the rows, where the caller has one.
    """
    rows = stored(_sized(docs, doc_id, text, row))
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    plan = deal(rows, total, shards, seed) if count else Plan({}, {}, [0] * shards, [])
    dealt = F.coalesce(_lookup(plan.groups, F.col("text_hash")), _lookup(plan.records, F.col("row")))
    spread = F.col("text_hash").isin(plan.split) if plan.split else F.lit(False)
    keyed = rows.withColumns(
        {
            "dealt": dealt,
            "key_id": F.when(spread, F.coalesce("doc_id", F.lit(LEAST))).otherwise(F.lit(LEAST)),
            "key_row": F.when(spread, F.col("row")).otherwise(F.lit(LEAST)),
        }
    )
    loose = keyed.where("dealt IS NULL")
    n, left = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters = split(loose, left, n, shards, seed) if n else []
    ranges = len(splitters) + 1
    # Dealt records are ranges of their own, cut by a hash of the row, so that a group of them is
    # not one task's.
    placed = with_range(keyed, splitters).withColumn(
        "range",
        F.when(F.col("dealt").isNull(), F.col("range"))
        .otherwise(ranges + F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int")),
    )
    filled = dict(
        placed.where("dealt IS NULL").groupBy("range").agg(F.sum("size")).collect()
    )
    starts = dict(zip(sorted(filled), accumulate(filled[r] for r in sorted(filled)), strict=True))
    before = {r: end - filled[r] for r, end in starts.items()}
    spark = docs.sparkSession
    offsets = F.broadcast(
        spark.createDataFrame(list(before.items()) or [(0, 0)], "range int, before long")
    )
    order = Window.partitionBy("range").orderBy("dealt", *KEY)
    rank = Window.partitionBy("range").orderBy("dealt", *KEY, "doc_id", "row")
    same = Window.partitionBy("range", "dealt", *KEY)
    # The middle of a place: twice the end of its bytes less its size.
    middle = 2 * (F.col("before") + F.sum("size").over(order)) - F.sum("size").over(same)
    ends = np.cumsum([int(x) for x in plan.room]).tolist()
    scale = 2 * left / ends[-1] if ends[-1] else 0.0
    bounds = F.array(*(F.lit(float(e * scale)) for e in ends[:-1])).cast("array<double>")
    within = F.size(F.filter(bounds, lambda b: b <= F.col("middle").cast("double")))
    numbered = stored(
        placed.join(offsets, "range", "left")
        .withColumns({"middle": middle, "at": F.row_number().over(rank)})
        .withColumn("shard", F.when(F.col("dealt").isNull(), within).otherwise(F.col("dealt")))
        .select("doc_id", "size", "text_crc32", "row", "range", "shard", "at")
    )
    cells = (
        numbered.groupBy("shard", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    taken, shift = [0] * shards, []
    for cell in sorted(cells, key=lambda c: (c["shard"], c["range"])):
        shift.append((cell["shard"], cell["range"], taken[cell["shard"]] - cell["first"]))
        taken[cell["shard"]] += cell["n"]
    shifts = F.broadcast(
        spark.createDataFrame(shift or [(0, 0, 0)], "shard int, range int, shift long")
    )
    return numbered.join(shifts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "row"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """Write ``docs`` with all their columns to ``path``, a folder for each shard with a column
    that names the slot; files hold consecutive slots. Returns the assignment."""
    spark = docs.sparkSession
    slot = free_name("slot", docs.columns)
    numbered, row = with_rows(docs)
    given = stored(assign(numbered, shards, seed, row=row))
    places = given.select(F.col("row").alias(row), F.col("slot").alias(slot), "shard")
    joined = numbered.drop("shard").join(places, row).drop(row)
    # Consecutive slots of a shard go to one task, so each task writes few files.
    joined.repartitionByRange(max(shards, partitions(spark)), "shard", slot).sortWithinPartitions(
        "shard", slot
    ).write.partitionBy("shard").parquet(path)
    return given


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
