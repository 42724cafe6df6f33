"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: the characters its weight asks for over those it has. A
document's number of copies is the inverse of the Poisson distribution with that mean at a uniform
number hashed from the seed and the document's id, so it does not depend on partitioning, retries or
other documents. Copies are exploded and dealt out by a hashed key, then ordered by it inside each
partition: a global shuffle in one exchange.

Weights name their sources, and all others share one weight, so rates are a list whose length is
that of the weights, whatever the number of sources in the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import hex_sha256, partitions, table, text_or_empty

SEED = 17
#: Production mix: the one very large source is held at a fifth, a few are lifted, the rest share.
WEIGHTS: Mapping[str, float] = {"src0": 0.20, "src1": 0.06, "src2": 0.06, "src3": 0.06}
REST = 0.62
#: Characters of the mix over characters of the input.
EXPANSION = 1.0
BITS = 52


def uniform(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")
    return bits.cast("double") * F.lit(2.0**-BITS)


def poisson_steps(mean: float) -> list[float]:
    """Distribution function of the Poisson law at 0, 1, ... until it is 1 to 52 bits."""
    steps, k, total = [], 0, 0.0
    while mean > 0:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if k > mean and total >= 1 - 2.0**-BITS or k > mean + 20 * math.sqrt(mean) + 40:
            break
        steps.append(total)
        k += 1
    return steps


def copies(mean: Mapping[str | None, float], group: Column, u: Column) -> Column:
    """Number of steps of the distribution function that lie at or below ``u``."""
    out = F.lit(0)
    for name, value in mean.items():
        steps = F.array(*(F.lit(x) for x in poisson_steps(value))).cast("array<double>")
        out = F.when(group == name, F.size(F.filter(steps, lambda x: x <= u))).otherwise(out)
    return out


def rates(
    docs: DataFrame, group: Column, length: Column, weights: Mapping[str, float], rest: float,
    expansion: float,
) -> dict[str, float]:
    """Mean repetitions by group: one row for each weight comes back from the aggregation."""
    have = {
        row[0]: row[1] for row in docs.groupBy(group).agg(F.sum(length).cast("bigint")).collect()
    }
    total = sum(have.values())
    share = {f"={name}": w for name, w in weights.items()} | {"*": rest}
    scale = sum(w for name, w in share.items() if have.get(name))
    return {
        name: w / scale * expansion * total / have[name]
        for name, w in share.items()
        if have.get(name)
    }


def mix(
    docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST,
    expansion: float = EXPANSION, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix: all columns of ``docs`` for each copy, plus ``__copy`` (from 1) and ``__key``, the
    place in the shuffled order; each partition is ordered by it.

    Weights are shares of characters. A source without a weight, and a null source, is of the rest;
    weights of sources that are absent go to the others in proportion. Rows that repeat an id get
    the same number of copies, as does a null id everywhere. Documents without characters take part
    like others and weigh nothing; where a group has no characters at all its rows are left out. An
    empty table gives no rows.
    """
    named = F.col(source).isin(list(weights)) if weights else F.lit(False)
    group = F.when(named, F.concat(F.lit("="), F.col(source))).otherwise("*")
    mean = rates(docs, group, F.length(text_or_empty(text)), weights, rest, expansion)
    n = copies(mean, group, uniform(seed, F.col(doc_id)))
    many = docs.withColumn(
        "__copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))
    )
    spread = F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"), F.col("__copy"))
    keyed = many.withColumn(
        "__key", F.conv(F.substring(F.md5(spread), 1, 15), 16, 10).cast("bigint")
    )
    return keyed.repartition(partitions(docs.sparkSession), "__key").sortWithinPartitions("__key")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", F.col("__copy").alias("copy"), F.col("__key").alias("shuffle_key"),
        hex_sha256(text_or_empty("text")).alias("text_sha256"),
    )


_NAMED = ", ".join(f"('={name}', {w!r}::DOUBLE)" for name, w in (*WEIGHTS.items(),))
OP2_SQL = f"""
WITH w(g, weight) AS (VALUES {_NAMED}, ('*', {REST!r}::DOUBLE)),
d AS (
  SELECT *, CASE WHEN '=' || source IN (SELECT g FROM w) THEN '=' || source ELSE '*' END AS g,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
      / pow(2.0::DOUBLE, {BITS}) AS u
  FROM documents),
h AS (SELECT g, sum(length(coalesce(text, ''))) AS have FROM d GROUP BY g HAVING have > 0),
m AS (
  SELECT g, weight / sum(weight) OVER () * {EXPANSION!r}::DOUBLE * sum(have) OVER () / have AS mean
  FROM h JOIN w USING (g)),
c AS (
  SELECT g, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS f
  FROM m, range(0, 400) AS t(k) WHERE k <= mean + 20 * sqrt(mean) + 40),
n AS (
  SELECT doc_id, source, text, count(*) AS n
  FROM (SELECT row_number() OVER () AS r, * FROM d) JOIN c USING (g) WHERE f <= u
  GROUP BY r, doc_id, source, text),
e AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, source, copy,
  ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id, copy)), 1, 15))::BIGINT AS shuffle_key,
  sha256(coalesce(text, '')) AS text_sha256
FROM e
"""
