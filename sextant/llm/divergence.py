"""Audit of how much the sources of a language differ in their words.

A translation table lowers A-Z and blanks every separator byte in one pass over a text, ``split``
gives its terms and a ``Counter`` their frequencies. A task adds the counters of its documents up,
group by group, and hands them on whenever they fill a bounded table; Spark sums what the tasks hand
on. Only terms that occur move, never a table of all groups by all terms.

Each (lang, source) group is a smoothed distribution over its language's kept terms, in billionths.
A term that a group lacks has one value for all such terms, so two groups are compared by blocks of
terms: a block is a small dense matrix filled with these values, over which the occurring cells are
written, and gives one partial sum for each pair of sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored, table, text_or_empty

#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 30
#: Added to every count.
SMOOTHING = 5
#: What the whole of a distribution is worth.
UNIT = 1_000_000_000
#: Ranks of the terms of a group that are returned.
TOP_TERMS = 50
#: Entries of a task's table of counts: more are handed on.
TABLE_TERMS = 200_000
#: Occurring cells of a block of terms, about.
BLOCK_CELLS = 100_000
#: Rows of a block that are compared at once.
CHUNK = 512

#: A-Z in lower case, a-z and all bytes of non-ASCII characters as they are, the rest blank.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def term_counts(text: str) -> Counter:
    """Frequencies of the terms (UTF-8) of a text."""
    return Counter(text.encode("utf-8", "surrogatepass").translate(_TERMS).split())


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it) of ``docs`` (lang, source,
    text), a row for each group and term."""

    def handed_on(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in groups.items():
            pairs = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(found), pa.string()),
                    pa.array([source] * len(found), pa.string()),
                    pa.array(list(found), pa.binary()),
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([p[1] for p in pairs], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(dict)
        size = 0
        for batch in batches:
            names = zip(
                batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True
            )
            for group, text in zip(names, batch.column("text"), strict=True):
                found = groups[group]
                before = len(found)
                for term, n in term_counts(text.as_py()).items():
                    pair = found.get(term)
                    if pair is None:
                        found[term] = [n, 1]
                    else:
                        pair[0] += n
                        pair[1] += 1
                size += len(found) - before
                if size > TABLE_TERMS:
                    yield from handed_on(groups)
                    groups.clear()
                    size = 0
        yield from handed_on(groups)

    found = docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact."""
    wide = "decimal(38,0)"
    over = (n.cast(wide) + F.lit(SMOOTHING).cast(wide)) * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + F.lit(SMOOTHING) * terms).cast(wide)
    return F.lit(1) + F.call_function("div", over.cast(wide), under)


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: the summed differences of all pairs of sources that have kept
    terms to differ in. ``cells`` has lang, source, term and p; ``groups`` lang, source and
    default, the value of the terms a source lacks."""
    blocks = max(1, -(-cells.count() // BLOCK_CELLS))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    rows = cells.select("lang", block.alias("block"), "source", "term", "p")
    # Every block of a language knows all of its sources.
    used = rows.select("lang", "block").distinct()
    heads = used.join(groups, "lang").select(
        "lang", "block", "source", F.lit(None).cast("string").alias("term"),
        F.col("default").alias("p"),
    )

    def run(block: pa.Table) -> pa.Table:
        source, term = block.column("source").to_pylist(), block.column("term").to_pylist()
        p = block.column("p").to_numpy()
        base = {s: v for s, t, v in zip(source, term, p, strict=True) if t is None}
        names = sorted(base, key=lambda s: s.encode("utf-8", "surrogatepass"))
        place = {s: i for i, s in enumerate(names)}
        start = np.array([base[s] for s in names], np.int64)
        at: dict = {}
        where = [
            (at.setdefault(t, len(at)), place[s], v)
            for s, t, v in zip(source, term, p, strict=True)
            if t is not None
        ]
        dense = np.tile(start, (len(at), 1))
        i, j, v = (np.array(x, np.int64) for x in zip(*where, strict=True))
        dense[i, j] = v
        a, b, value = [], [], []
        for k in range(len(names) - 1):
            total = np.zeros(len(names) - k - 1, np.int64)
            for first in range(0, len(dense), CHUNK):
                part = dense[first : first + CHUNK]
                total += np.abs(part[:, k + 1 :] - part[:, k : k + 1]).sum(axis=0)
            a += [names[k]] * len(total)
            b += names[k + 1 :]
            value.append(total)
        lang = block.column("lang")[0].as_py()
        return pa.table(
            {
                "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()),
                "b": pa.array(b, pa.string()),
                "value": pa.array(np.concatenate(value) if value else [], pa.int64()),
            }
        )

    parts = rows.unionByName(heads).groupBy("lang", "block").applyInArrow(
        run, "lang string, a string, b string, value long"
    )
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others of its
    language (``pair``: all other sources, by the summed differences of their shares of the kept
    terms) and which terms set it apart (``term``: the ``top_terms`` kept terms that it has and that
    have a larger share of it than of the language). Ranks count from 1 by falling value; equal
    values go by the item's UTF-8.

    Null text, lang and source are empty ones; a group without terms is compared like others, and
    where a language keeps no term all values are 0. A repeated row counts as often as it is there.
    A term of any length is one term. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"),
        text_or_empty(text).alias("text"),
    )
    found = stored(counts(rows))
    kept = stored(
        found.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs)
        .select("lang", "term", "lang_n")
    )
    cells = stored(found.drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")
    )
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        )
    )
    valued = stored(
        cells.join(groups, ["lang", "source"]).select(
            "lang", "source", "term",
            share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
    )
    default = share(F.lit(0), F.col("total"), F.col("terms"))
    sums = stored(
        pair_sums(
            valued.drop("q"),
            groups.where("terms > 0").select("lang", "source", default.alias("default")),
        )
    )
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    # Languages without kept terms: all of their pairs are in the result, at 0.
    bare = groups.where("terms = 0").select("lang", "source")
    equal = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item")
    pairs = both.unionByName(equal.withColumn("value", F.lit(0).cast("long")))
    terms = valued.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(part: DataFrame, name: str) -> DataFrame:
        return part.withColumn("rank", F.row_number().over(order)).select(
            "lang", "source", F.lit(name).alias("part"), "item", "value", "rank"
        )

    top = ranked(terms, "term").where(F.col("rank") <= top_terms)
    return ranked(pairs, "pair").unionByName(top)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2
  HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.term, k.lang_n, count(w.term) AS n
  FROM g JOIN k USING (lang)
  LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
  GROUP BY 1, 2, 3, 4),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own FROM c),
p AS (
  SELECT lang, source, term, n,
    1 + ({UNIT}::HUGEINT * (n + {SMOOTHING})) // (own + {SMOOTHING} * v)::HUGEINT AS p,
    1 + ({UNIT}::HUGEINT * (lang_n + {SMOOTHING})) // (total + {SMOOTHING} * v)::HUGEINT AS q
  FROM s JOIN l USING (lang)),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(abs(y.p - z.p)) FROM p y JOIN p z USING (lang, term)
      WHERE y.lang = a.lang AND y.source = a.source AND z.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
