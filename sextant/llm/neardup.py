"""Near-duplicate detection with HyperMinHash sketches.

A text's set of word shingles is hashed to 64 bits. The top bits choose one of 256 registers; a
register keeps the smallest rest it saw, compressed to the number of leading zeros and ten bits of
mantissa: 16 bits. Bands of registers find candidates, registers estimate the Jaccard similarity of
a candidate pair (corrected for registers that agree by accident), and pairs the estimate cannot
rule out are confirmed on the full sets.

Bands of 5 registers, 51 of them: a pair with similarity 0.8 shares a band with probability
1 - (1 - 0.8^5)^51, so one pair in a billion is missed. For the bands, an empty register borrows
from the first filled one in an order of its own, so that two texts agree in a register with the
probability of their similarity whatever their length, and bands of short texts stay selective.

Only components are asked for, so a bucket of n texts never becomes n^2 pairs:

1. Texts with equal sets are one class; everything below is about classes.
2. Each bucket's members are compared with one pivot, each member only with its most similar pivot.
3. In buckets that still hold several components, members outside the largest are compared with a
   random member of it. A stray shares many buckets, so it meets many members.
4. What still shares a bucket across components is compared with one member m of the largest. Those
   that resemble it are compared by their differences to a consensus of theirs: two texts are similar
   only if they are close to it or share differences, and then they share one among the rarest of
   both (``by_differences``). Independent edits of one text have no difference in common, so a group
   of copies with any number of strays stays linear. What hardly resembles m is far, by the triangle
   inequality, from what is close to it; such members get a new m, round by round, until the pairs
   that are left in all buckets are no more than a few for each class: those are compared directly.

Every pair of a bucket is then in one component, or compared, or ruled out. Sets are made only for
classes that share a bucket, from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored, table, text_or_empty, with_rows
from sextant.llm.graph import connect

REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
BAND = 5
BANDS = REGISTERS // BAND
#: Estimates may miss by so many standard deviations before a pair is ruled out.
SIGMAS = 6.0
#: Estimated similarity to a group's member m from which, and up to which, a text is compared by
#: differences, and directly. Similar texts differ by at most 0.2 in it, and estimates by 0.1 each.
NEAR, FAR = 0.25, 0.65
#: Chance that two different minima of equal rates share a register, times 2^mantissa bits.
COLLISION = 0.1699
#: Words whose hashes a worker remembers at most.
MEMO_WORDS = 100_000
#: Members that a group's consensus is made of, and those of a part of a group, about.
CONSENSUS, PART = 63, 500
#: Rounds, at most, in which what is left of a bucket gets a new member to compare with, and the
#: members of a bucket that are paired at once.
ROUNDS, FEW = 4, 8
#: Pairs left in all buckets, for each class that shares one, that are compared directly: a class has
#: met more than that in its first buckets.
PAIRS = 8

#: Places of the bits that tell texts whose sets are surely not wanted, 4 MB in all.
PLACES = 1 << 25

#: Pipeline stage and library default: five-word shingles, similarity 0.8.
WORDS = 5
PERCENT = 80

#: For each register, the order in which it looks for one to borrow from.
_BORROW = np.random.default_rng(11).permuted(
    np.tile(np.arange(REGISTERS, dtype=np.uint8), (REGISTERS, 1)), axis=1
)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; empty without words."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(hashes))
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set: zero where no hash fell."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = hashes[first] & np.uint64((1 << (64 - REGISTER_BITS)) - 1)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = 64 - REGISTER_BITS - exponent
    steps = 1 << MANTISSA_BITS
    mantissa = np.clip(np.floor((fraction * 2 - 1) * steps), 0, steps - 1).astype(np.int64)
    out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS) | mantissa
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, text_key, n_shingles, set_key (null if empty) and registers of each document;
    ``docs`` has row, doc_id, text_key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            sizes, keys, regs = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), words, memo)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                regs.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("text_key"),
                    pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(regs, pa.binary()),
                ],
                ["row", "doc_id", "text_key", "n_shingles", "set_key", "registers"],
            )

    return docs.mapInArrow(
        run,
        "row long, doc_id long, text_key binary, n_shingles long, set_key binary, registers binary",
    )


def _column_arrays(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def estimated(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, int]:
    """Similarity by registers, corrected for accidental agreement, and the registers in use."""
    used = int(np.count_nonzero(a | b))
    agree = int(np.count_nonzero((a == b) & (a != 0)))
    p = COLLISION / (1 << MANTISSA_BITS) * 4 * n_a * n_b / (n_a + n_b) ** 2
    return (agree / used - p) / (1 - p), used


def estimates(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with their estimate and whether it leaves ``percent`` possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = percent / 100
        for batch in batches:
            left = _column_arrays(batch.column("regs_a"), np.uint16)
            right = _column_arrays(batch.column("regs_b"), np.uint16)
            sizes = zip(
                batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True
            )
            values, possible = [], []
            for i, (n_a, n_b) in enumerate(sizes):
                value, used = estimated(left[i], right[i], n_a, n_b)
                slack = SIGMAS * np.sqrt(least * (1 - least) / used)
                values.append(value)
                possible.append(
                    bool(value >= least - slack and 100 * min(n_a, n_b) >= percent * max(n_a, n_b))
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a"), batch.column("b"),
                    pa.array(values, pa.float64()), pa.array(possible, pa.bool_()),
                ],
                ["a", "b", "estimate", "possible"],
            )

    def side(name: str) -> DataFrame:
        return sketch.select(
            F.col("node").alias(name), F.col("registers").alias(f"regs_{name}"),
            F.col("n_shingles").alias(f"n_{name}"),
        )

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(run, "a long, b long, estimate double, possible boolean")


def plausible(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose estimate does not rule out ``percent``, with the estimate."""
    return estimates(pairs, sketch, percent).where("possible").select("a", "b", "estimate")


def _consensus(near: DataFrame, sets: DataFrame) -> DataFrame:
    """m, hashes: what most of up to ``CONSENSUS`` members of each group have. Any set would give
    the same pairs; the closer it is to all members, the fewer differences there are."""
    order = Window.partitionBy("m").orderBy(F.xxhash64("node"), "node")
    some = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= CONSENSUS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _column_arrays(batch.column("hashes"), np.int64)
            m = np.repeat(batch.column("m").to_numpy(zero_copy_only=False), [len(x) for x in found])
            elements = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(elements)], ["m", "element"])

    elements = some.select("m", "node").join(sets, "node").select("m", "hashes").mapInArrow(
        run, "m long, element long"
    )
    counted = elements.groupBy("m", "element").agg(F.count(F.lit(1)).alias("n"))
    sizes = some.groupBy("m").agg(F.count(F.lit(1)).alias("members"))
    common = counted.join(sizes, "m").where(2 * F.col("n") > F.col("members"))
    heads = common.groupBy("m").agg(F.collect_list("element").alias("common"))
    return sizes.join(heads, "m", "left").select("m", F.coalesce("common", F.array()).alias("common"))


def differences(near: DataFrame, sets: DataFrame) -> DataFrame:
    """m, node, comp, element, n, size, head: what each member has and its group's consensus lacks,
    or the other way round; ``n`` of them, ``size`` elements in the member. A member without any has
    one row without an element. ``head`` marks one row of each member.

    The consensus goes once to each part of a group, ahead of the members of that part.
    """
    heads = _consensus(near, sets)
    counts = near.groupBy("m").agg((F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    salted = near.join(counts, "m").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts") + 1).cast("int")
    )
    members = salted.join(sets, "node").select("m", "part", "node", "comp", "hashes", F.lit(None).cast("array<long>").alias("common"))
    leads = heads.join(counts, "m").select(
        "m", F.explode(F.sequence(F.lit(0), "parts")).alias("part"), F.lit(None).cast("long").alias("node"),
        F.lit(None).cast("long").alias("comp"), F.lit(None).cast("binary").alias("hashes"), "common",
    )
    names = ["m", "node", "comp", "element", "n", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.empty(0, np.uint64)
        for batch in batches:
            m, node, comp = (batch.column(c).to_pylist() for c in ("m", "node", "comp"))
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i in range(len(batch)):
                if node[i] is None:
                    common = np.sort(np.array(batch.column("common")[i].as_py(), np.int64).view(np.uint64))
                    continue
                x = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.uint64)
                found = np.setxor1d(x, common, assume_unique=True)
                rows = max(1, len(found))
                element = found.view(np.int64) if len(found) else np.zeros(1, np.int64)
                for column, value in zip(out, (m[i], node[i], comp[i], element, len(found), len(x)), strict=True):
                    column.append(np.broadcast_to(np.int64(value) if np.isscalar(value) else value, rows))
            if out[0]:
                head = np.concatenate([np.arange(len(x)) == 0 for x in out[0]])
                columns = [np.concatenate(c) for c in out] + [head]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "head"])

    ordered = members.unionByName(leads).repartition("m", "part").sortWithinPartitions(
        "m", "part", F.col("node").isNotNull()
    )
    return ordered.mapInArrow(run, ", ".join(f"{name} long" for name in names) + ", head boolean")


def by_differences(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach ``percent``, by their differences D to
    their group's consensus; ``near`` has m, node and comp.

    Two sets of sizes s and t reach it if (100 + percent) (|D| + |E| - 2 |D & E|) is at most
    (100 - percent) (s + t). With e = (100 + percent) |D| - (100 - percent) s, that is
    2 (100 + percent) |D & E| >= e + f. All members that the one with the least e can take without a
    common difference are paired with it, and so are in one component. Each further pair has a
    member, a stray, that has a common difference with the other one, and one among the first of
    both in order of rising frequency in the group.
    """
    rows = stored(differences(near, sets))
    over = F.col("n") * (100 + percent) - F.col("size") * (100 - percent)
    nodes = rows.where("head").select("m", "node", "comp", "n", "size", over.alias("over"))
    least = nodes.groupBy("m").agg(
        F.min("over").alias("least"), F.min_by("node", F.struct("over", "node")).alias("core"),
        F.min_by("comp", F.struct("over", "node")).alias("comp_core"),
    )
    placed = stored(nodes.join(least, "m").withColumn("stray", F.col("over") + F.col("least") > 0))
    direct = placed.where("NOT stray AND comp != comp_core").select(
        F.col("node").alias("a"), F.col("core").alias("b")
    )
    strays = placed.where("stray").groupBy("m").agg(F.min("over").alias("least_stray"))
    bounded = placed.join(strays, "m")

    def first(with_least: str) -> Column:
        """Differences that must be looked at: all but those that the overlap may not miss."""
        overlap = F.ceil((F.col("over") + F.col(with_least)) / (2 * (100 + percent)))
        return F.col("n") - F.greatest(overlap, F.lit(1)) + 1

    bounds = bounded.select(
        "m", "node", "comp", "size", "stray", first("least").alias("long"),
        first("least_stray").alias("short"),
    )
    often = stored(rows.where("n > 0").groupBy("m", "element").agg(F.count(F.lit(1)).alias("often")))
    shared = rows.where("n > 0").select("m", "node", "element").join(often, ["m", "element"])
    order = Window.partitionBy("m", "node").orderBy("often", "element")
    ranked = shared.withColumn("at", F.row_number().over(order)).where("often > 1")
    looked = stored(
        ranked.join(bounds, ["m", "node"]).where(F.col("at") <= F.greatest("long", "short"))
    )

    def side(part: DataFrame, name: str) -> DataFrame:
        return part.select(
            "m", "element", F.col("node").alias(name), F.col("comp").alias(f"comp_{name}"),
            F.col("size").alias(f"size_{name}"), F.col("stray").alias(f"stray_{name}"),
        )

    pairs = side(looked.where("stray AND at <= long"), "a").join(
        side(looked.where("at <= short"), "b"), ["m", "element"]
    )
    # Two strays are met from both sides; one is enough.
    once_each = (~F.col("stray_b")) | (F.col("a") < F.col("b"))
    some = pairs.where("comp_a != comp_b").where(once_each).where(alike_in_size(percent))
    return some.select("a", "b").distinct().unionByName(direct)


def alike_in_size(percent: int) -> Column:
    """Sets of other sizes cannot reach ``percent``."""
    a, b = F.col("size_a"), F.col("size_b")
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose full sets reach ``percent`` of similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = _column_arrays(batch.column("set_a"), np.uint64)
            right = _column_arrays(batch.column("set_b"), np.uint64)
            keep = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("hashes").alias(f"set_{name}"))

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(run, "a long, b long")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands of a sketch that has at least one filled register."""
    filled = regs != 0
    source = np.arange(REGISTERS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        chosen = np.flatnonzero(filled)
        source[empty] = chosen[_BORROW[empty[:, None], chosen[None, :]].argmin(axis=1)]
    values = (source.astype(np.uint64) << np.uint64(16)) | regs[source].astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in values[: BANDS * BAND].reshape(BANDS, BAND).T:
        keys = _mixed(keys + column)
    return keys


def bands(sketch: DataFrame) -> DataFrame:
    """key, node: one row per band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_keys(x) for x in _column_arrays(batch.column("registers"), np.uint16)]
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            keys = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])

    return sketch.select("node", "registers").mapInArrow(run, "key long, node long")


def perhaps_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` (text_key, text) without most of those whose key is not in ``wanted``, so that only
    few texts are shuffled for sets that nobody asks for.

    Every wanted key sets one of ``PLACES`` bits, which are sent to all tasks: 4 MB at most, whatever
    the tables hold. Other keys pass by chance; the caller's join leaves them out.
    """
    place = F.pmod(F.xxhash64("text_key"), F.lit(PLACES)) + 1
    bits = (
        wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    at = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(octet, (at % 8).cast("int")) == 1
    placed = texts.withColumn("bucket", F.bitmap_bucket_number(place))
    return placed.join(F.broadcast(bits), "bucket").where(hit).select("text_key", "text")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, hashes: the full sets of the wanted nodes (node, text_key), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            found = [
                shingle_set(text.as_py(), words, memo).tobytes() for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(found, pa.binary())], ["node", "hashes"]
            )

    likely = perhaps_wanted(docs.select("text_key", "text"), wanted)
    texts = likely.join(wanted, "text_key").select("node", "text")
    # A repeated row (same id, same text) finds the same node more than once.
    return texts.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def near_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
    text: str = "text", row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id, kept.

    Two texts are linked if their sets of ``words``-word shingles (words: runs of characters other
    than ASCII white space; A-Z in lower case; a text with fewer words is one shingle) share at
    least ``percent`` per cent of their union. ``component_id`` is the smallest id in the component
    and ``kept`` marks that row; of rows that repeat it, the first. Null text, empty text and text
    of white space have no set: such rows are linked with nothing and kept. Null ids are larger
    than all others. Other columns are ignored; an empty table gives no rows. ``row`` names a column
    that numbers the rows, where the caller has one.
    """
    value = text_or_empty(text)
    keyed = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), value)))
        .alias("text_key"),
        value.alias("text"),
    )
    rows = stored(sketches(keyed, words))
    full = rows.where("set_key IS NOT NULL")
    classes = stored(
        full.groupBy("set_key").agg(
            F.min("row").alias("node"),
            F.min("doc_id").alias("least_id"),
            F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("least_row"),
        )
    )
    nodes = classes.select("node")
    sketch = full.withColumnRenamed("row", "node")
    cut = stored(bands(sketch.join(nodes, "node", "left_semi")))
    shared = cut.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"))
    member = stored(cut.join(stored(shared.where("n > 1").drop("n")), "key"))
    labels = stored(member.select("node").distinct().withColumn("comp", F.col("node")))
    keys = stored(sketch.join(labels.select("node"), "node").select("node", "text_key"))
    sets = stored(sets_of(keyed, keys, words))

    def joined(labels: DataFrame, pairs: DataFrame, best: bool) -> DataFrame:
        likely = plausible(pairs, sketch, percent)
        if best:
            likely = likely.groupBy("a").agg(F.max_by("b", "estimate").alias("b"))
        links = stored(confirmed(stored(likely.select("a", "b")), sets, percent))
        return connect(labels, links)

    first = member.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    labels = joined(labels, first.distinct(), best=True)

    def mixed_buckets(labels: DataFrame) -> DataFrame:
        """key, node, comp of the buckets that hold several components."""
        placed = stored(member.select("key", "node").join(labels, "node"))
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        keys = stored(several.where("lo != hi").select("key"))
        return stored(placed.join(keys, "key", "left_semi"))

    # The largest component of each bucket; its size and, for ties, its label decide.
    rank = F.col("n").cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)") + F.col("comp")

    def largest(open_: DataFrame) -> DataFrame:
        """key, m (a member of the bucket's largest component), main (that component)."""
        by_comp = open_.groupBy("key", "comp").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("key", "node")).alias("pivot")
        )
        return stored(
            by_comp.groupBy("key").agg(
                F.max_by("pivot", rank).alias("m"), F.max_by("comp", rank).alias("main")
            )
        )

    open_ = mixed_buckets(labels)
    strays = open_.join(largest(open_), "key").where("comp != main")
    pairs = strays.select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
    labels = joined(labels, pairs, best=False)

    def apart(low: DataFrame) -> DataFrame:
        """All pairs of a bucket's members of which one hardly resembles m."""
        sized = low.join(sketch.select("node", "n_shingles"), "node")

        def end(name: str) -> DataFrame:
            return sized.select(
                "key", F.col("node").alias(name), F.col("comp").alias(f"comp_{name}"),
                F.col("estimate").alias(f"to_m_{name}"), F.col("n_shingles").alias(f"size_{name}"),
            )

        some = end("a").join(end("b"), "key").where(
            (F.col("comp_a") < F.col("comp_b"))
            & (F.least("to_m_a", "to_m_b") < NEAR)
            & alike_in_size(percent)
        )
        return some.select("a", "b")

    open_ = mixed_buckets(labels)
    pairs, texts = None, labels.count()
    for round_ in range(ROUNDS):
        main = largest(open_)
        if not round_:
            # A label is a node of its component: buckets of one component share their member.
            main = main.withColumn("m", F.col("main"))
        grouped = stored(open_.join(main, "key").select("key", "m", "node", "comp", "main"))
        members = stored(grouped.select("m", "main", "node", "comp").distinct())
        measured = stored(
            members.where("node != m").join(
                estimates(
                    members.where("node != m").select(F.col("node").alias("a"), F.col("m").alias("b")),
                    sketch, percent,
                ).select(F.col("a").alias("node"), F.col("b").alias("m"), "estimate", "possible"),
                ["node", "m"],
            )
        )
        direct = measured.where("possible AND comp != main").select(
            F.col("node").alias("a"), F.col("m").alias("b")
        )
        near = measured.where(F.col("estimate") >= NEAR).select("m", "node", "comp")
        heads = members.select("m", F.col("m").alias("node"), F.col("main").alias("comp")).distinct()
        close = by_differences(stored(near.unionByName(heads)), sets, percent)
        found = stored(direct.unionByName(close).distinct())
        pairs = found if pairs is None else pairs.unionByName(found)
        # Pairs with a member that hardly resembles m: both are far from it. The few members of a
        # small bucket are paired at once, larger ones go on to another m, unless all their pairs
        # are no more than a few for each class.
        far = measured.where(F.col("estimate") < FAR).select("m", "node", "estimate")
        low = stored(grouped.select("key", "m", "node", "comp").join(far, ["m", "node"]))
        left = low.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("estimate").alias("lowest"),
            F.count(F.lit(1)).alias("members"),
        )
        keys = left.where("lo != hi").where(F.col("lowest") < NEAR).select("key", "members")
        low = stored(low.join(keys, "key"))
        wide = low.where(F.col("members") > FEW)
        twice = wide.agg(F.sum("members")).first()[0] or 0
        last = round_ == ROUNDS - 1 or twice <= 2 * PAIRS * texts
        pairs = pairs.unionByName(apart(low if last else low.where(F.col("members") <= FEW)))
        if last:
            break
        open_ = wide.select("key", "node", "comp")
    labels = joined(labels, pairs.distinct(), best=False)

    placed = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(
        F.min("least_id").alias("component_id"),
        F.coalesce(F.min_by("least_row", "least_id"), F.min("least_row")).alias("keep_row"),
    )
    by_set = placed.join(least, "comp").select("set_key", "component_id", "keep_row")
    linked = full.select("row", "doc_id", "n_shingles", "set_key").join(by_set, "set_key")
    alone = rows.where("set_key IS NULL").select(
        "row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.select(
        "row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("keep_row")).alias("kept")
    ).unionByName(alone)


def keep_distinct(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns of ``docs``. Nulls, empty texts, repeated rows
    and ties are decided as in :func:`near_components`; an empty table stays empty."""
    numbered, row = with_rows(docs)
    found = near_components(numbered, words, percent, row=row)
    stay = found.where("kept").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = """
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, hash(a, b) AS h FROM (
    SELECT r, w[i] AS a, w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM t)
    UNION ALL SELECT r, w[1], NULL FROM t WHERE len(w) = 1)),
c AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT x.r AS a, y.r AS b, count(*) AS m FROM s x JOIN s y ON x.h = y.h AND x.r < y.r
      GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN c p ON p.r = a JOIN c q ON q.r = b
      WHERE 100 * m >= 80 * (p.n + q.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(r, d) AS (
  SELECT r, doc_id FROM t
  UNION SELECT e.b, reach.d FROM reach JOIN e ON e.a = reach.r),
g AS (SELECT r, min(d) AS component_id FROM reach GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM t JOIN g USING (r) LEFT JOIN c USING (r)
"""
