"""Toxicity: a linear classifier over character n-grams, features scaled by naive Bayes ratios.

Features are the hashed 3-, 4- and 5-grams of the lower-cased UTF-8 bytes. Each is scaled by its
log-count ratio (how much likelier it is in toxic than in other texts), less where few texts show
it, and a logistic regression is fitted on the scaled features, both kinds weighing the same. A text
is scored by its most toxic passage: the weights of the n-grams that start within ``PASSAGE`` bytes,
the largest sum over all such passages. So a long text is held against the same measure as a short
one, and all of it counts. It is fitted in the same way: counts are of whole texts, and the
regression sees each text by the passage that is its most toxic one under the weights so far.

Fitting uses a bounded sample: whole texts of any length, at most ``SAMPLE_ROWS`` of them and no more
after ``SAMPLE_BYTES``, so one task holds it. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sextant.llm.common import table, text_or_empty

GRAMS = (3, 4, 5)
BITS = 20
PASSAGE = 400
#: The sample: labelled rows in the order of a hash of their ids, so many at most, up to and with the
#: row that reaches the bytes. A row's length does not decide whether it is taken.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 128 << 20
#: A feature must be in so many sampled texts.
LEAST_TEXTS = 3
ROUNDS, RATE, RIDGE = 30, 0.1, 1e-3
#: A ratio counts in full from so many standard errors on, below by the square of the share.
SURE = 10
#: How often each text's passage is chosen: by the ratios, then by the weights fitted before.
CHOICES = 2
#: Passages that a step of the fit takes at a time.
BLOCK = 2_000
#: Bytes of a text that are scored at a time.
SEGMENT = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = np.random.default_rng(5).integers(1, 2**32, (max(GRAMS), 256), np.uint64).astype(np.uint32)


def grams(data: bytes) -> np.ndarray:
    """Hashed n-grams by length of gram and start; ``data`` ends in max(GRAMS) more bytes."""
    codes = np.frombuffer(data, np.uint8)
    n = len(codes) - max(GRAMS)
    out, h = [], np.full(n, 0x9E3779B1, np.uint32)
    for i in range(max(GRAMS)):
        h = (h ^ _SEEDS[i][codes[i : i + n]]) * np.uint32(0x85EBCA6B)
        if i + 1 in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2 * i + 0x2C1B3C6D)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return np.stack(out)


def padded(text: str) -> bytes:
    return b" " + text.encode("utf-8", "surrogatepass").translate(_LOWER) + b" " * max(GRAMS)


def windows(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights over the passages that start at each place."""
    sums = np.r_[0.0, np.cumsum(weights[found].sum(axis=0, dtype=np.float64))]
    width = min(PASSAGE, len(sums) - 1)
    return sums[width:] - sums[: len(sums) - width]


def passage(data: bytes, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The n-grams of the most toxic passage of padded bytes, and their sum."""
    found, best, tail = np.empty(0, np.int32), -np.inf, max(GRAMS)
    for start in range(0, max(1, len(data) - tail), SEGMENT):
        part = grams(data[start : start + SEGMENT + PASSAGE - 1 + tail])
        sums = windows(part, weights)
        at = int(sums.argmax())
        if sums[at] > best:
            found, best = part[:, at : at + PASSAGE].ravel(), float(sums[at])
    return found, best


def fit(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights of all hashed n-grams and the bias, from padded texts. Without texts of both kinds,
    all weights are 0."""
    y = np.array(labels, np.float64)
    size, positive = 1 << BITS, float(y.sum())
    bias = float(np.log((positive + 1) / (len(y) - positive + 1)))
    if not 0 < positive < len(y):
        return np.zeros(size, np.float32), bias
    toxic, other = np.ones(size), np.ones(size)
    for data, label in zip(texts, labels, strict=True):
        tail = max(GRAMS)
        seen = [
            np.unique(grams(data[start : start + SEGMENT + tail]))
            for start in range(0, max(1, len(data) - tail), SEGMENT)
        ]
        found = seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))
        (toxic if label else other)[found] += 1
    ratio = np.log(toxic / (positive + 2)) - np.log(other / (len(y) - positive + 2))
    ratio[toxic + other < LEAST_TEXTS + 2] = 0
    ratio *= np.minimum(1, np.abs(ratio) / np.sqrt(1 / toxic + 1 / other) / SURE) ** 2
    each = np.where(y > 0, 0.5 / positive, 0.5 / (len(y) - positive))
    weights, beta = ratio, np.zeros(size)
    for _ in range(CHOICES):
        chosen = [passage(data, weights)[0] for data in texts]
        squares, square = np.full(size, 1e-8), 1e-8
        for _ in range(ROUNDS):
            gradient, slope = np.zeros(size), 0.0
            weights = beta * ratio
            for start in range(0, len(y), BLOCK):
                rows = slice(start, start + BLOCK)
                lengths = np.array([len(found) for found in chosen[rows]])
                found = np.concatenate(chosen[rows])
                sums = np.add.reduceat(weights[found], np.r_[0, np.cumsum(lengths)[:-1]])
                z = np.clip(sums + bias, -30, 30)
                error = (1 / (1 + np.exp(-z)) - y[rows]) * each[rows]
                gradient += np.bincount(found, np.repeat(error, lengths), size)
                slope += float(error.sum())
            gradient = gradient * ratio + RIDGE * beta / len(y)
            squares += gradient * gradient
            square += slope * slope
            beta -= RATE * gradient / np.sqrt(squares)
            bias -= RATE * slope / np.sqrt(square)
        weights = beta * ratio
    return weights.astype(np.float32), bias


def toxicity(text: str, weights: np.ndarray, bias: float) -> float:
    data, best = padded(text), -np.inf
    tail = max(GRAMS)
    for start in range(0, max(1, len(data) - tail), SEGMENT):
        part = data[start : start + SEGMENT + PASSAGE - 1 + tail]
        best = max(best, float(windows(grams(part), weights).max()))
    return float(1 / (1 + np.exp(-np.clip(best + bias, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) outside the held-out ids.

    Rows without a label or id are not used. The sampled ids (at most SAMPLE_ROWS) are broadcast, so
    no text is shuffled but those of the sample, to the one task that fits; it reads them in order
    and keeps whole ones until there are SAMPLE_ROWS or SAMPLE_BYTES of them.
    """
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(SAMPLE_ROWS)
    )
    sample = (
        docs.select("doc_id", text_or_empty("text").alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .repartition(1)
        .sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                if len(texts) < SAMPLE_ROWS and size < SAMPLE_BYTES:
                    texts.append(padded(text.as_py()))
                    labels.append(toxic.as_py())
                    size += len(texts[-1])
        weights, bias = fit(texts, labels)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    found = sample.mapInArrow(run, "weights binary, bias double").first()
    if found is None:  # nothing to learn from: every score is a half
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(found["weights"], np.float32), found["bias"]


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", to: str = "score"
) -> DataFrame:
    """``docs`` plus the column ``to`` (0 to 1, larger: likelier toxic), which replaces one of that
    name. Null text is empty and gets the score of the bias alone; equal texts get equal scores; an
    empty table stays empty; other columns pass through. The model is broadcast: 4 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            found = [toxicity(t.as_py() or "", weights, bias) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, to]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(to, DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
