"""Removal of repeated passages, by suffixes sorted in a distributed merge sort.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts somewhere else. Sorting
all suffixes of a corpus would move hundreds of times its size. Instead, only suffixes at anchors
are sorted: of the 64-byte grams in each window of ``LENGTH`` bytes, the one with the smallest hash
(the leftmost of equals) is the window's anchor. Equal windows have their anchor at the same place,
so a window is repeated if and only if another one has an equal anchor gram, equal bytes before and
equal bytes after it. One suffix in 169 is an anchor.

1. Anchors are found text by text. A record is an anchor with the bytes of all its windows.
2. Grams are counted; those that occur once are done. Of the others, records are counted: all
   windows of a record that occurs twice or more are repeated.
3. What is left (groups of one gram with different records, at least one of them single) is sorted.
   Tasks make sorted runs of the suffixes at the anchors, front-coded, one block for each bucket of
   grams; buckets merge their runs with a loser tree that never compares known prefixes again. The
   common prefixes it yields, and those of the sorted reversed left sides, tell for each distance
   of a window's start from the anchor which records agree.
4. The spans go back to the texts by text digest, and the bytes are cut out.

Bytes of texts move twice (to make the runs, to cut), all else is hashes. Hot grams: counts are
combined before each shuffle. A gram with more than ``GROUP`` different records is not gathered in
one place: its windows are counted one by one by digest, again combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sextant.llm.common import stored, table, text_or_empty
from sextant.llm.lcp_merge import common, make_run, merge, pack, unpack

LENGTH = 400
GRAM = 64
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20
#: Records that a task sorts into one run, records in a bucket on average, and the most different
#: records of one gram that are gathered in one place.
RUN, BUCKET, GROUP = 10_000, 20_000, 20_000

_MASK = np.uint64((1 << 22) - 1)
_BYTES = np.random.default_rng(23).integers(1, 2**64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers for the rolling hash, made once per worker."""

    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = 1 << max(12, (n - 1).bit_length())
        if size not in cls.made:
            cls.made.clear()
            cls.made[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        up, down = cls.made[size]
        return up[:n], down[:n]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    up, down = _Tables.get(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(codes) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: bytes, ends: np.ndarray, length: int, gram: int):
    """Anchors of texts that lie one after the other in ``data``: number of the text, anchor, first
    and last window (all but the first as places in ``data``), and the gram's hash."""
    codes = np.frombuffer(data, np.uint8)
    hashes = gram_hashes(codes, gram)
    placed = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_least(placed, length - gram + 1) & _MASK).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    counts = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(ends)), counts)
    first = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts)
    windows = np.arange(len(owner)) + first
    at = least[windows]
    change = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[change[1:], len(at)] - 1
    return owner[change], at[change], windows[change], windows[last], hashes[at[change]]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts (or stretches of long ones) put together into segments: numbers, offsets, bytes, ends."""
    who, offsets, parts, size = [], [], [], 0
    for i, data in enumerate(texts):
        for start in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[start : start + SEGMENT + length - 1]
            if len(part) < length:
                continue
            who.append(i)
            offsets.append(start)
            parts.append(part)
            size += len(part)
            if size >= SEGMENT:
                yield who, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                who, offsets, parts, size = [], [], [], 0
    if parts:
        yield who, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


ANCHORS = "doc long, loc long, gram long, rec1 long, rec2 long, text_key binary"
#: loc packs the anchor's place and how far before it the first and the last window start.
NEAR = 9


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Records of ``docs`` (doc, text_key, text), and one row per text with its key (no gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_ = batch.column("doc").to_numpy(zero_copy_only=False)
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")]
            for who, offsets, data, ends in _pieces(texts, length):
                owner, at, lo, hi, hashes = anchors_of(data, ends, length, gram)
                base = np.r_[0, ends[:-1]] - np.array(offsets)
                loc = ((at - base[owner]) << 2 * NEAR) | ((at - lo) << NEAR) | (at - hi)
                view = memoryview(data)
                digests = b"".join(
                    [
                        xxhash.xxh3_128_digest(view[a:b])
                        for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)
                    ]
                )
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                near = (loc & ((1 << 2 * NEAR) - 1)) * np.int64(0x1E3779B97F4A7C15)
                n = len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs_[np.array(who)[owner]]), pa.array(loc),
                        pa.array(hashes.view(np.int64)), pa.array(pair[:, 0] ^ near),
                        pa.array(np.ascontiguousarray(pair[:, 1])), pa.nulls(n, pa.binary()),
                    ],
                    names,
                )
            long = pa.array([i for i, t in enumerate(texts) if len(t) >= length], pa.int64())
            none = pa.nulls(len(long), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(long), none, none, none, none,
                    batch.column("text_key").take(long),
                ],
                names,
            )

    names = [part.split()[0] for part in ANCHORS.split(", ")]
    return docs.mapInArrow(run, ANCHORS)


def _spans_of(repeated: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values, end exclusive."""
    edges = np.flatnonzero(np.diff(np.r_[0, repeated.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def resolve(
    members: list[tuple[int, bytes, bytes, int, int]], length: int
) -> list[tuple[int, int, int]]:
    """Repeated windows of the records of one gram.

    Members are (common prefix with the one before, right side, left side, first distance, payload)
    in the order of their right sides. A window is named by the distance of its start from the
    anchor. Gives (payload, least distance, largest distance) for each stretch.
    """
    n = len(members)
    right = np.array([m[0] for m in members])
    right[0] = 0
    low = np.array([length - len(m[1]) for m in members])
    high = np.array([len(m[2]) for m in members])
    reverse = [m[2][::-1] for m in members]
    order = sorted(range(n), key=reverse.__getitem__)
    left = np.zeros(n, np.int64)
    for a, b, k in zip(order, order[1:], range(1, n), strict=False):
        left[k] = common(reverse[a], reverse[b])
    if n == 2:
        first, last = max(length - int(right[1]), *low.tolist()), min(int(left[1]), *high.tolist())
        return [(m[4], first, last) for m in members] if first <= last else []
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Between two of these distances the same records agree.
    cuts = np.unique(np.r_[length - right[1:], left[1:] + 1, low, high + 1])
    cuts = cuts[(cuts >= low.min()) & (cuts <= high.max() + 1)]
    marks = np.zeros((len(cuts), n), bool)
    for i, d in enumerate(cuts[:-1].tolist()):
        key = np.cumsum(right < length - d) * np.int64(n + 1)
        key += np.cumsum(left < d)[place]
        fits = (low <= d) & (d <= high)
        _, inverse, counts = np.unique(key[fits], return_inverse=True, return_counts=True)
        marks[i, fits] = counts[inverse] > 1
    out = []
    for j in np.flatnonzero(marks.any(axis=0)).tolist():
        out += [(members[j][4], int(cuts[a]), int(cuts[b]) - 1) for a, b in _spans_of(marks[:, j])]
    return out


SPANS = "doc long, start long, end long"


def _unpack_loc(loc: int) -> tuple[int, int, int]:
    """Anchor, and the first and last window's distance before it (the last one is nearer)."""
    near = (1 << NEAR) - 1
    return loc >> 2 * NEAR, (loc >> NEAR) & near, loc & near


def cut_records(texts: DataFrame, length: int) -> DataFrame:
    """The left and right bytes of the wanted records: ``texts`` has text and wanted, an array of
    structs (gram, doc, loc, single, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                rows = wanted.as_py()
                left, right = [], []
                for row in rows:
                    at, far, near = _unpack_loc(row["loc"])
                    left.append(data[at - far : at])
                    right.append(data[at : at - near + length])
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: [row[c] for row in rows] for c in ("gram", "doc", "loc", "single", "hot")},
                        "left": left, "right": right,
                    },
                    schema=schema,
                )

    schema = pa.schema(
        [
            ("gram", pa.int64()), ("doc", pa.int64()), ("loc", pa.int64()), ("single", pa.bool_()),
            ("hot", pa.bool_()), ("left", pa.binary()), ("right", pa.binary()),
        ]
    )
    return texts.mapInArrow(
        run, "gram long, doc long, loc long, single boolean, hot boolean, left binary, right binary"
    )


def sorted_spans(records: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Repeated spans of the single records, by merging sorted runs bucket by bucket."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, rows in held.items():
                run = make_run([(row[0], i) for i, row in enumerate(rows)])
                side = [rows[i] for *_, i in run]
                packed = pack([(lcp, text, i) for i, (lcp, text, _) in enumerate(run)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": [bucket], "run": [packed],
                        "lefts": [[row[1] for row in side]], "docs": [[row[2] for row in side]],
                        "locs": [[row[3] for row in side]], "singles": [[row[4] for row in side]],
                    },
                    schema=schema,
                )

        for batch in batches:
            columns = [
                batch.column(c).to_pylist() for c in ("gram", "right", "left", "doc", "loc", "single")
            ]
            for key, *row in zip(*columns, strict=True):
                held.setdefault(key % buckets, []).append(row)
                count += 1
            if count >= RUN:
                yield from flush()
                held.clear()
                count = 0
        yield from flush()

    schema = pa.schema(
        [
            ("bucket", pa.int64()), ("run", pa.binary()), ("lefts", pa.list_(pa.binary())),
            ("docs", pa.list_(pa.int64())), ("locs", pa.list_(pa.int64())),
            ("singles", pa.list_(pa.bool_())),
        ]
    )

    def merged(blocks: pa.Table) -> pa.Table:
        packed = [unpack(block) for block in blocks.column("run").to_pylist()]
        sides = [
            list(zip(*parts, strict=True))
            for parts in zip(
                *(blocks.column(c).to_pylist() for c in ("lefts", "docs", "locs", "singles")), strict=True
            )
        ]
        tagged = [
            [(lcp, text, (r << 32) | i) for lcp, text, i in run] for r, run in enumerate(packed)
        ]
        found: list[tuple[int, int, int]] = []
        group: list[tuple] = []

        def settle() -> None:
            if len(group) > 1:
                for tag, first, last in resolve(group, length):
                    _, doc, loc, single = sides[tag >> 32][tag & 0xFFFFFFFF]
                    if single:
                        at = _unpack_loc(loc)[0]
                        found.append((doc, at - last, at - first + length))

        for lcp, text, tag in merge(tagged):
            if lcp < gram:
                settle()
                group.clear()
            group.append((lcp, text, sides[tag >> 32][tag & 0xFFFFFFFF][0], 0, tag))
        settle()
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table(
            {c: pa.array(x, pa.int64()) for c, x in zip(("doc", "start", "end"), columns, strict=True)}
        )

    blocks = records.drop("hot").mapInArrow(
        runs,
        "bucket long, run binary, lefts array<binary>, docs array<long>, locs array<long>, "
        "singles array<boolean>",
    )
    return blocks.groupBy("bucket").applyInArrow(merged, SPANS)


def counted_spans(records: DataFrame, length: int) -> DataFrame:
    """Repeated spans of the single records, by counting their windows one by one."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("left", "right", "doc", "loc", "single")]
            for left, right, doc, loc, single in zip(*columns, strict=True):
                at, far, near = _unpack_loc(loc)
                data = left + right
                digests = b"".join(
                    [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(far - near + 1)]
                )
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                n = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()),
                        # A record that occurs twice or more counts for itself.
                        pa.array(np.full(n, 1 if single else 2)), pa.array(np.full(n, doc)),
                        pa.array(np.arange(at - far, at - near + 1)),
                    ],
                    ["w1", "w2", "n", "doc", "start"],
                )

    all_ = records.mapInArrow(windows, "w1 long, w2 long, n long, doc long, start long")
    twice = all_.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1")
    return (
        all_.where("n = 1")
        .join(twice.select("w1", "w2"), ["w1", "w2"])
        .select("doc", "start", (F.col("start") + length).alias("end"))
    )


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """text_key and spans (start, end of bytes, unmerged) of each text with repeated windows;
    ``docs`` has text_key and text."""
    numbered = docs.withColumn("doc", F.monotonically_increasing_id())
    found = stored(find_anchors(numbered, length, gram))
    keys = found.where("text_key IS NOT NULL").select("doc", "text_key")
    anchors = found.where("text_key IS NULL").drop("text_key")
    often = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared = stored(anchors.join(often, "gram"))
    records = stored(
        shared.groupBy("gram", "rec1", "rec2").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min_by("loc", "doc").alias("loc")
        )
    )
    full = (
        shared.join(records.where("n > 1").select("gram", "rec1", "rec2"), ["gram", "rec1", "rec2"])
        .select(
            "doc",
            F.shiftright("loc", 2 * NEAR).alias("at"),
            F.shiftright("loc", NEAR).bitwiseAND((1 << NEAR) - 1).alias("far"),
            F.col("loc").bitwiseAND((1 << NEAR) - 1).alias("near"),
        )
        .select("doc", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + length).alias("end"))
    )
    groups = records.groupBy("gram").agg(
        F.count(F.lit(1)).alias("different"), F.min("n").alias("least")
    )
    mixed = groups.where("different > 1 AND least = 1").select(
        "gram", (F.col("different") > GROUP).alias("hot")
    )
    open_ = records.join(mixed, "gram").join(keys, "doc")
    wanted = open_.groupBy("text_key").agg(
        F.collect_list(F.struct("gram", "doc", "loc", (F.col("n") == 1).alias("single"), "hot"))
        .alias("wanted")
    )
    # One of equal texts is enough: a record's place is that of one text.
    texts = docs.join(wanted, "text_key").select("text", "wanted")
    cut = stored(cut_records(texts, length).dropDuplicates(["doc", "loc"]))
    buckets = max(1, cut.where("NOT hot").count() // BUCKET)
    spans = full.unionByName(sorted_spans(cut.where("NOT hot"), buckets, length, gram))
    spans = spans.unionByName(counted_spans(cut.where("hot"), length))
    # Equal texts have equal spans: those of the first are taken.
    first = keys.groupBy("text_key").agg(F.min("doc").alias("doc"))
    by_doc = spans.join(first, "doc").groupBy("text_key").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    return by_doc


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """``docs`` plus ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (the remaining bytes;
    a span may cut a character), which replace columns of these names.

    Texts are taken as UTF-8. A byte goes if a string of ``length`` bytes that covers it also starts
    at another place, of this or any other row; so of equal texts that long nothing stays. Null text
    is empty; shorter texts stay as they are; an empty table stays empty; other columns pass through.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes")
    value = text_or_empty(text)
    key = F.unhex(F.md5(value))
    spans = repeated_spans(docs.select(key.alias("text_key"), value.alias("text")), length, gram)
    rows = docs.withColumn("__key", key).join(
        spans.withColumnRenamed("text_key", "__key").withColumnRenamed("spans", "__spans"), "__key", "left"
    )
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, kept = [], [], [], []
            for value, spans in zip(batch.column(text), batch.column("__spans"), strict=True):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                cut = merged_spans([(s["start"], s["end"]) for s in spans.as_py() or ()])
                at, parts = 0, []
                for start, end in cut:
                    parts.append(data[at:start])
                    at = end
                rest = b"".join([*parts, data[at:]])
                sizes.append(len(data))
                gone.append(len(data) - len(rest))
                counts.append(len(cut))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in fields), pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                [*(f.name for f in fields), "n_bytes", "n_removed", "n_spans", "kept_bytes"],
            )

    added = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return rows.drop("__key").mapInArrow(
        run, StructType([*fields, *added, StructField("kept_bytes", BinaryType())])
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeat"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
    )
