"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule is a column expression that rejects a text. Its cost (seconds of Spark time a row) and
its selectivity (rejected share) are measured on a sample of the rows; the cascade is one CASE that
tries the rules by falling rejection per cost, so that a row pays only up to the first rule that
rejects it. The verdict is the same in every order, only the work differs. All of it is expressions
on one row: no shuffle, no Python.

The window rule works on hashes of eight-word windows. Texts whose hashes are all different (most)
stop there; for the others the windows are sorted with their places, equal neighbours are compared
word by word, and the covered words are summed in one pass: n log n for a text of any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import stored, table, text_or_empty

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 8

#: Limits of the rules. The first two are the base; the others are set so that text written as
#: sentences passes whatever its subject.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOLS_PERCENT = 10
MAX_DUP_LINES_PERCENT = 50
MAX_MARKS_PERCENT = 50
MIN_WORD_TENTHS, MAX_WORD_TENTHS = 20, 150

#: Share of the rows whose cost and selectivity are measured; the sample grows with the input.
SAMPLE_FRACTION = 0.002


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def full_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """The words of each text in ``__words``.

    They are made by a generator of one row: the optimizer puts no later filter below it, which
    would split the text again wherever a rule looks at a word.
    """
    words = F.explode(F.array(words_of(text_or_empty(text))))
    return docs.drop("__words").select("*", words.alias("__words"))


def window_hashes(words: Column) -> Column:
    """Hashes of all windows of eight words, by place; none if there are fewer words."""
    last = F.size(words) - (WINDOW - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def repeated_words(hashes: Column, words: Column) -> Column:
    """Words inside windows that occur twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        equal = (a["h"] == b["h"]) & (
            F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW)
        )
        return F.coalesce(equal, F.lit(False))

    # The sorted array is bound as the only element of an array, so that it is made once.
    repeats = F.flatten(
        F.transform(
            F.array(placed),
            lambda s: F.filter(
                s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))
            ),
        )
    )
    starts = F.sort_array(F.transform(repeats, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).cast("bigint").alias("n"),
            (i + WINDOW).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    several = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(several, covered).otherwise(F.lit(0).cast("bigint"))


def signal(name: str, text: str = "text") -> Column:
    """A signal as an expression over the text and ``__words``."""
    value, words = text_or_empty(text), F.col("__words")
    if name == "n_words":
        return F.size(words).cast("bigint")
    if name == "word_chars":
        return F.length(F.array_join(words, "")).cast("bigint")
    if name == "n_symbols":
        return F.regexp_count(value, F.lit(SYMBOL)).cast("bigint")
    if name == "n_marks":
        return F.regexp_count(value, F.lit("!")).cast("bigint")
    if name == "n_lines":
        return F.size(full_lines(value)).cast("bigint")
    if name == "n_dup_lines":
        return F.aggregate(
            F.array(full_lines(value)),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + F.size(x) - F.size(F.array_distinct(x)),
        )
    if name == "n_repeat_words":
        return F.aggregate(
            F.array(window_hashes(words)),
            F.lit(0).cast("bigint"),
            lambda acc, h: acc + repeated_words(h, words),
        )
    raise KeyError(name)


Signals = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Signals], Column]


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda s: s("n_words") < MIN_WORDS),
    Rule("repeats", lambda s: 100 * s("n_repeat_words") > MAX_REPEAT_PERCENT * s("n_words")),
    Rule("symbols", lambda s: 100 * s("n_symbols") > MAX_SYMBOLS_PERCENT * s("n_words")),
    Rule("lines", lambda s: 100 * s("n_dup_lines") > MAX_DUP_LINES_PERCENT * s("n_lines")),
    Rule("marks", lambda s: 100 * s("n_marks") > MAX_MARKS_PERCENT * s("n_words")),
    Rule(
        "word_length",
        lambda s: (10 * s("word_chars") < MIN_WORD_TENTHS * s("n_words"))
        | (10 * s("word_chars") > MAX_WORD_TENTHS * s("n_words")),
    ),
)


def measure_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    fraction: float = SAMPLE_FRACTION,
) -> list[dict]:
    """Cost (seconds a row, above that of reading the words) and selectivity of each rule on a
    sample of the rows, the best rejection per cost first. With no sampled row all rules tie and
    keep their order."""
    # Reads the sample's words once, so that the costs are those of the rules.
    sample = stored(with_words(docs.sample(fraction, seed=7).select(text), text))

    def timed(column: Column) -> tuple[float, int, int]:
        start = time.perf_counter()
        n, hits = sample.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(column.cast("int")), F.lit(0))
        ).first()
        return time.perf_counter() - start, n, hits

    idle, n, _ = timed(F.size("__words") < 0)
    found = []
    for rule in rules:
        seconds, _, hits = timed(rule.rejects(lambda s: signal(s, text)))
        cost, share = max(seconds - idle, 1e-3) / max(n, 1), hits / max(n, 1)
        found.append({"rule": rule, "cost": cost, "selectivity": share, "gain": share / cost})
    return sorted(found, key=lambda row: -row["gain"])


def first_rejection(order: Sequence[Rule], signals: Signals) -> Column:
    """The first rule of the cascade that rejects the row, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.rejects(signals), F.lit(rule.name)).otherwise(out)
    return out


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[Rule]:
    return [row["rule"] for row in measure_rules(docs, rules, text)]


def assess(
    docs: DataFrame, order: Sequence[Rule], text: str = "text", signals: Signals | None = None
) -> DataFrame:
    """``docs`` (with ``__words``) plus ``rejected_by``: the first rule that rejects, else null.

    Null text is the empty text, which has no words. Repeated rows get the same verdict, an empty
    table stays empty, other columns pass through. ``signals`` names columns where signals have
    been computed already; else the rules compute theirs only when their turn comes.
    """
    signals = signals or (lambda name: signal(name, text))
    return docs.withColumn("rejected_by", first_rejection(order, signals))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they had."""
    judged = assess(with_words(docs, text), plan_cascade(docs, text=text), text)
    return judged.where(F.col("rejected_by").isNull()).select(*docs.columns)


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_words(docs).withColumns(
        {name: signal(name) for name in (*REPORTED, "n_marks", "n_lines")}
    )
    judged = assess(rows, plan_cascade(docs), signals=F.col)
    base = RULES[0].rejects(F.col) | RULES[1].rejects(F.col)
    return judged.select(
        "doc_id", *REPORTED, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept")
    )


OP5_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t),
p AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
q AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
c AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM q) GROUP BY r),
s AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(replace(text, '!', '')) AS n_marks, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
      AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= {MAX_SYMBOLS_PERCENT} * n_words
  AND 100 * n_dup_lines <= {MAX_DUP_LINES_PERCENT} * n_lines
  AND 100 * n_marks <= {MAX_MARKS_PERCENT} * n_words
  AND 10 * word_chars BETWEEN {MIN_WORD_TENTHS} * n_words AND {MAX_WORD_TENTHS} * n_words AS kept
FROM b
"""
