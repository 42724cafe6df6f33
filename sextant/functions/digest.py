"""Content hashes, cache keys and order-free fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CACHE_VERSION = 3  # fixed value
LANES = 4
LANE_DIGITS = 15


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def line_count(text: Column) -> Column:
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(newlines + 1)


def lane_values(item: Column) -> list[Column]:
    """A string's SHA-256 cut into four 60-bit numbers."""
    digest = F.sha2(item, 256)
    parts = [F.substring(digest, lane * LANE_DIGITS + 1, LANE_DIGITS) for lane in range(LANES)]
    return [F.conv(part, 16, 10).cast("decimal(20,0)") for part in parts]


def lane_sums(item: Column) -> list[Column]:
    """Aggregates that together identify a multiset of strings: the sums of their lanes.

    Sums combine on the map side, so a group of any size needs neither a sort nor a collected list.
    """
    return [F.sum(value).alias(f"lane_{lane}") for lane, value in enumerate(lane_values(item))]


def lanes_digest(count: Column, length: int, *lead: Column) -> Column:
    """Digest of the sums from :func:`lane_sums`, the item count and leading fields."""
    sums = [
        F.coalesce(F.col(f"lane_{lane}"), F.lit(0)).cast("decimal(38,0)").cast("string")
        for lane in range(LANES)
    ]
    fields = [part.cast("string") for part in (*lead, count)] + sums
    return F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, length)


def answer_key(hash_: Column, model: Column, state: Column) -> Column:
    parts = [F.lit(str(CACHE_VERSION)), hash_, model, F.coalesce(state, F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def digest_fields(fields: list[Column], length: int) -> Column:
    """Digest of a row's fields in a fixed order; a missing field keeps its place."""
    texts = [F.coalesce(field.cast("string"), F.lit("\u0000")) for field in fields]
    joined = reduce(lambda left, right: F.concat(left, F.lit("|"), right), texts)
    return F.substring(F.sha2(joined, 256), 1, length)
