"""License scans with template automata.

A template has mandatory words, optional regions and replaceable regions. It is compiled into an
automaton over words whose states are made when they are first reached; reading words from a start,
it accepts if the mandatory words are there exactly, whatever stands in the regions. Starts are the
places of a template's first two words, which are found by a byte search, so only a few places of a
text are read by an automaton, and each for at most the template's length. Texts are scanned whole,
each by itself: one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from sextant.llm.common import table, text_or_empty
from sextant.llm.license_texts import PHRASES, TEMPLATES

#: Bytes of words: digits, letters in lower case, and all beyond ASCII; others separate.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
PLACES = "array<struct<label:string,start:bigint,end:bigint,base:boolean>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


Part = bytes | tuple[int, int] | list  # a word, a replaceable region, an optional region


def parse(template: str) -> list[Part]:
    """The parts of a template in order."""
    stack: list[list[Part]] = [[]]
    for piece in re.split(r"(<<[^>]*>>)", template):
        if piece == "<<opt>>":
            stack.append([])
        elif piece == "<</opt>>":
            inner = stack.pop()
            stack[-1].append(inner)
        elif piece.startswith("<<var:"):
            low, high = piece[6:-2].split("-")
            stack[-1].append((int(low), int(high)))
        else:
            stack[-1].extend(words_of(piece))
    (parts,) = stack
    return parts


@dataclass
class Automaton:
    """States are numbered; ``words`` and ``any`` lead on by a word, ``free`` without one."""

    label: str
    base: bool
    first: bytes
    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[int | None] = field(default_factory=lambda: [None])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    made: dict = field(default_factory=dict)

    def state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def build(self, parts: list[Part], at: int) -> int:
        for part in parts:
            after = self.state()
            if isinstance(part, bytes):
                self.words[at][part] = after
            elif isinstance(part, list):
                self.free[at].append(after)
                self.free[self.build(part, self._enter(at))].append(after)
            else:
                low, high = part
                for k in range(high):
                    if k >= low:
                        self.free[at].append(after)
                    self.any[at] = following = self.state()
                    at = following
                self.free[at].append(after)
            at = after
        return at

    def _enter(self, at: int) -> int:
        inside = self.state()
        self.free[at].append(inside)
        return inside

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """The states after a word; words in no template share one entry of the table."""
        known = any(word in self.words[s] for s in states)
        key = (states, word if known else None)
        found = self.made.get(key)
        if found is None:
            on = [self.words[s][word] for s in states if word in self.words[s]]
            on += [self.any[s] for s in states if self.any[s] is not None]
            found = self.made[key] = self.closure(on)
        return found

    def match(self, words: list[bytes], start: int) -> int:
        """The largest end of an accepted stretch that begins at ``start``, -1 if there is none."""
        states, end = self.begin, -1
        for i in range(start, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.accept in states:
                end = i + 1
        return end


def compile_template(label: str, template: str, base: bool) -> Automaton:
    parts = parse(template)
    if not all(isinstance(p, bytes) for p in parts[:2]) or len(parts) < 2:
        raise ValueError(f"{label}: a template begins with two mandatory words")
    out = Automaton(label, base, b" " + b" ".join(parts[:2]) + b" ")
    out.accept = out.build(parts, 0)
    out.begin = out.closure([0])
    return out


@lru_cache(maxsize=1)
def automata() -> list[Automaton]:
    phrases = [compile_template(label, text, True) for label, text in PHRASES.items()]
    return phrases + [compile_template(label, text, False) for label, text in TEMPLATES.items()]


def places(words: list[bytes], machines: list[Automaton]) -> list[dict]:
    """Accepted stretches of words: label, start, end, base."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for machine in machines:
        at, seen, index = joined.find(machine.first), 0, 0
        while at >= 0:
            index += joined.count(b" ", seen, at)
            seen = at
            end = machine.match(words, index)
            if end >= 0:
                out.append({"label": machine.label, "start": index, "end": end, "base": machine.base})
            at = joined.find(machine.first, at + 1)
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words`` and ``places``, which replace columns of these names.

    A place has the label of its phrase or template, the first word and the one after the last
    (words from 0), and whether it is a base phrase. Null text is empty and has no words; a text
    without a license has no places; repeated rows get equal results; an empty table stays empty;
    other columns pass through.
    """
    docs = docs.drop("n_words", "places")
    kind = pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata()
        for batch in batches:
            counts, found = [], []
            for value in batch.column(text):
                words = words_of(value.as_py() or "")
                counts.append(len(words))
                found.append(places(words, machines))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind)],
                [*batch.schema.names, "n_words", "places"],
            )

    added = [StructField("n_words", LongType()), StructField("places", _parse_datatype_string(PLACES))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def _labels(rows: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(rows, lambda p: p["label"]))), ",")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    whole = F.exists("places", lambda p: ~p["base"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"),
        F.when(whole, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def _pattern(parts: list[Part]) -> str:
    """A template as a pattern over words that are each followed by a space."""
    out = ""
    for part in parts:
        if isinstance(part, bytes):
            out += part.decode() + " "
        elif isinstance(part, list):
            out += f"(?:{_pattern(part)})?"
        else:
            out += f"(?:[^ ]+ ){{{part[0]},{part[1]}}}"
    return out


def _sql() -> str:
    def phrase(words: list[bytes]) -> str:
        return " AND ".join(f"w[i + {k}] = '{word.decode()}'" for k, word in enumerate(words))

    base = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM u WHERE {phrase(words_of(text))}"
        for label, text in PHRASES.items()
    )
    whole = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label FROM j WHERE regexp_matches(s, ' {_pattern(parse(text))}')"
        for label, text in TEMPLATES.items()
    )
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
u AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM t),
j AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
b AS ({base}),
x AS ({whole}),
g AS (
  SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM b GROUP BY r),
l AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM x) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN r IN (SELECT r FROM x) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE
       ELSE 0.0::DOUBLE END AS score
FROM t LEFT JOIN g USING (r) LEFT JOIN l USING (r)
"""


OP9_SQL = _sql()
