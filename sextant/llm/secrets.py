"""Secret scans with corpus-wide ownership.

Candidates are found by pattern in every text. How often a candidate's value is copied decides what
it is: values are hashed and counted by distinct repositories and distinct owners over the whole
corpus; one that many owners have is an example from documentation, one that a single owner has and
that looks random is likely live. The live ones add spans of their own.

Texts are scanned once; only candidates (a place, a value's hash, its owner) are stored and moved.
Counts go by (hash, owner, repository), then (hash, owner), then hash, each combined before its
shuffle, so a value that a third of all documents share costs a row per task. The verdicts come back
by a sort-merge join whose hot side adaptive execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import hex_sha256, stored, table, text_or_empty


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret, and the least length of that group."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: In a run of hexadecimal digits only the whole run can match, so its least length is part of the
#: pattern; the other patterns match first and are then judged by length.
KINDS: tuple[Kind, ...] = (
    Kind(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 6,
    ),
    Kind("access", "AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
    # Tokens that well-known services mark by a prefix.
    Kind(
        "issued",
        "\\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}"
        "|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})",
        0, 14, base=False,
    ),
)
LIVE = "live"
#: Order of kinds that start at one place.
ORDER = {k.name: i for i, k in enumerate(KINDS)} | {LIVE: len(KINDS)}

#: A value that so many owners have is an example; a live one has one owner, this length at least,
#: a digit, and so many different characters.
EXAMPLE_OWNERS = 3
LIVE_LENGTH = 16
LIVE_CHARACTERS = 8


def _found(text: Column, kind: Kind) -> Column:
    """Matches in order, each with the length of the text between it and the one before."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
    return F.aggregate(
        F.array(matches),
        F.lit(None).cast("array<struct<match:string,gap:int>>"),
        lambda acc, m: F.when(
            F.size(m) > 0,
            F.flatten(
                F.transform(
                    F.array(gaps),
                    lambda g: F.transform(
                        m, lambda x, i: F.struct(x.alias("match"), F.get(g, i).alias("gap"))
                    ),
                )
            ),
        ),
    )


def looks_random(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & (distinct >= LIVE_CHARACTERS)
    )


def scan(
    docs: DataFrame, doc_id: str, text: str, owner: Column, repository: Column
) -> DataFrame:
    """One stored row per document: row, doc_id, owner, repository and the raw matches by kind."""
    value = text_or_empty(text)
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(owner, F.lit("")).alias("owner"),
            F.coalesce(repository, F.lit("")).alias("repository"),
            *(_found(value, kind).alias(kind.name) for kind in KINDS),
        )
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per match that is long enough, with its place in code points and its value.

    Places are running sums over the matches of one text and kind, so the window is one text.
    """
    place = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for kind in KINDS:
        rows = scanned.where(F.col(kind.name).isNotNull()).select(
            "row", "doc_id", "owner", "repository", F.posexplode(kind.name).alias("at", "x")
        )
        match = F.col("x")["match"]
        secret = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
        ends = rows.select(
            "row", "doc_id", "owner", "repository",
            F.lit(kind.name).alias("kind"), F.length(match).alias("length"),
            secret.alias("value"),
            F.sum(F.col("x")["gap"] + F.length(match)).over(place).alias("end"),
        )
        parts.append(ends.where(F.length("value") >= kind.least))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        "row", "doc_id", "owner", "repository", "kind",
        (F.col("end") - F.col("length")).alias("start"), "end",
        F.length("value").cast("bigint").alias("value_length"),
        looks_random(F.col("value")).alias("random"),
        hex_sha256(F.col("value")).alias("hash"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_places, n_repositories, n_owners over the whole corpus."""
    by_repository = found.groupBy("hash", "owner", "repository").agg(
        F.count(F.lit(1)).alias("places")
    )
    by_owner = by_repository.groupBy("hash", "owner").agg(
        F.sum("places").alias("places"), F.count(F.lit(1)).alias("repositories")
    )
    return by_owner.groupBy("hash").agg(
        F.sum("places").alias("n_places"),
        F.sum("repositories").alias("n_repositories"),
        F.count(F.lit(1)).alias("n_owners"),
    )


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    owner: Column | None = None, repository: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, and ``spans``, an array of structs ordered by start and
    kind: start, kind_order, kind, end (code points, end exclusive), base, verdict ('live',
    'example' or 'shared'), n_repositories and n_owners of the value.

    ``owner`` and ``repository`` are columns of ``docs``: here a source owns its texts, and its
    texts of one language are a repository of it. Null text is empty, a null owner or repository is
    one of its own (the empty name). A document without candidates has no spans. Repeated rows are
    rows of their own. Other columns are ignored; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    scanned = scan(docs, doc_id, text, owner, repository)
    found = stored(candidates(scanned))
    verdict = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example")
        .when((F.col("n_owners") == 1) & F.col("random"), LIVE)
        .otherwise("shared")
    )
    judged = found.join(ownership(found), "hash").withColumn("verdict", verdict)
    kinds = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    base = F.col("kind").isin([k.name for k in KINDS if k.base])
    facts = ("verdict", "n_repositories", "n_owners")

    def span(start: Column, end: Column, kind: Column, is_base: Column) -> Column:
        return F.struct(
            start.alias("start"), kinds[kind].alias("kind_order"), kind.alias("kind"),
            end.alias("end"), is_base.alias("base"), *facts,
        )

    own = span(F.col("start"), F.col("end"), F.col("kind"), base)
    live = span(F.col("end") - F.col("value_length"), F.col("end"), F.lit(LIVE), F.lit(False))
    spans = judged.select(
        "row", "doc_id",
        F.explode(
            F.when(F.col("verdict") == LIVE, F.array(own, live)).otherwise(F.array(own))
        ).alias("span"),
    )
    with_spans = spans.groupBy("row").agg(F.collect_set("span").alias("spans"))
    ids = scanned.select("row", "doc_id")
    return ids.join(with_spans, "row", "left").select(
        "doc_id",
        F.sort_array(F.coalesce("spans", F.array().cast(with_spans.schema["spans"].dataType))).alias("spans"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("bigint")

    def of_kind(name: str):
        return lambda span: span["kind"] == name

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(count(of_kind(k.name)).alias(f"n_{k.name}") for k in KINDS if k.base),
        hex_sha256(_listed(base)).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        count(of_kind(LIVE)).alias("n_live"),
        count(lambda s: s["base"] & (s["verdict"] == "example")).alias("n_example"),
    )


def _sql() -> str:
    # Matching without regard to case would also take two letters beyond ASCII in DuckDB.
    pattern = {k.name: k.pattern.replace("'", "''") for k in KINDS}
    words = ["password", "passwd", "secret", "token", "api_?key"]
    either = "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words
    )
    pattern["assign"] = pattern["assign"].replace("(?i:" + "|".join(words) + ")", either)
    union = " UNION ALL ".join(
        f"""SELECT r, doc_id, owner, repo, '{k.name}' AS kind, {ORDER[k.name]} AS ord,
          {k.base} AS base, m, least, i, p,
          {f"regexp_extract(m, '{pattern[k.name]}', {k.group})" if k.group else "m"} AS value
        FROM (SELECT *, {k.least} AS least, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i
              FROM (SELECT r, doc_id, owner, repo,
                      regexp_extract_all(text, '{pattern[k.name]}') AS ms,
                      string_split_regex(text, '{pattern[k.name]}') AS p
                    FROM t WHERE regexp_matches(text, '{pattern[k.name]}')))"""
        for k in KINDS
    )
    listed = "kind || ':' || s || ':' || e"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
a AS ({union}),
b AS (
  SELECT *, sum(length(p[i]) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM a),
c AS (SELECT *, e - length(m) AS s, sha256(value) AS h FROM b WHERE length(value) >= least),
o AS (SELECT h, count(DISTINCT owner) AS owners FROM c GROUP BY h),
j AS (
  SELECT c.*, owners, owners = 1 AND length(value) >= {LIVE_LENGTH}
    AND regexp_matches(value, '[0-9]')
    AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS live
  FROM c JOIN o USING (h)),
x AS (
  SELECT r, kind, ord, base, s::BIGINT AS s, e::BIGINT AS e, owners FROM j
  UNION SELECT r, '{LIVE}', {ORDER[LIVE]}, false, (e - length(value))::BIGINT, e::BIGINT, 1
  FROM j WHERE live),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)},
    coalesce(string_agg({listed}, ',' ORDER BY s, ord) FILTER (base), '') AS based,
    string_agg({listed}, ',' ORDER BY s, ord) AS spans,
    count(*) FILTER (kind = '{LIVE}') AS n_live,
    count(*) FILTER (base AND owners >= {EXAMPLE_OWNERS}) AS n_example
  FROM x GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)},
  sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (r)
"""


OP3_SQL = _sql()
