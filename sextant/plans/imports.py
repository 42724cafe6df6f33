"""Import resolution over the bound tables: parts are files of four languages, line items are
import statements that name another part in its language's own way.

One part in three has the other form of file (package, index, module folder, test), one in seven
has both, and one order in eleven names what does not exist. ``resolve_go`` and ``import_graph`` lay the
files out in a few wide folders and write out every edge; for the others, folders hold some twenty
parts, so their number grows with the parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import modules, packages
from sextant.operators.packages import Links
from sextant.sources.bindings import Tables

GO_MODULE = "example.org/mono"
LANGUAGES = ("python", "typescript", "go", "rust")

# Expressions that Spark and the check read alike. k, d: a part's key and folder.
LANGUAGE = "CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' ELSE 'rust' END"
PATH = """CASE k % 4
  WHEN 0 THEN concat('py/', d, '/m', k, CASE WHEN k % 3 = 0 THEN '/__init__.py' ELSE '.py' END)
  WHEN 1 THEN concat('web/', d, '/c', k,
    CASE WHEN k % 3 = 0 THEN '/index.ts' WHEN k % 5 = 0 THEN '.js' ELSE '.ts' END)
  WHEN 2 THEN concat('go/', d, '/f', k, CASE WHEN k % 3 = 0 THEN '_test.go' ELSE '.go' END)
  ELSE concat('crates/src/', d, '/r', k, CASE WHEN k % 3 = 0 THEN '/mod.rs' ELSE '.rs' END) END"""
OTHER_PATH = """CASE k % 4
  WHEN 0 THEN concat('py/', d, '/m', k, CASE WHEN k % 3 = 0 THEN '.py' ELSE '/__init__.py' END)
  WHEN 1 THEN concat('web/', d, '/c', k, CASE WHEN k % 3 = 0 THEN '.ts' ELSE '/index.ts' END)
  WHEN 2 THEN concat('go/', d, '/g', k, '.go')
  ELSE concat('crates/src/', d, '/r', k, CASE WHEN k % 3 = 0 THEN '.rs' ELSE '/mod.rs' END) END"""
# s, t: keys of the importing and the imported part, td: the latter's folder, n: the line's number,
# gone: a suffix that makes the name one of nothing.
SPEC = """CASE s % 4
  WHEN 0 THEN CASE WHEN n % 2 = 0 THEN concat('.m', t, gone) ELSE concat('py.', td, '.m', t, gone) END
  WHEN 1 THEN concat(CASE WHEN s % 3 = 0 THEN '../../' ELSE '../' END, td, '/c', t, gone,
    CASE WHEN n % 3 = 0 THEN '.js' ELSE '' END)
  WHEN 2 THEN concat('example.org/mono/go/', td, gone)
  ELSE CASE WHEN n % 2 = 0 THEN concat('super::r', t, gone)
    ELSE concat('crate::', td, '::r', t, gone) END END"""
FOLDER = "concat('d', p_size % 5, 'x', CAST(floor(p_partkey / 100) AS BIGINT))"
WIDE_FOLDER = "concat('d', p_size % 5)"
TARGET = "(l_partkey - 1 + 4 * (l_linenumber * 7 + l_suppkey % 5)) % parts + 1"
GONE = "CASE WHEN l_orderkey % 11 = 0 THEN 'zz' ELSE '' END"


def files(t: Tables, folder: str = FOLDER) -> DataFrame:
    parts = t.read("part").selectExpr("p_partkey AS k", f"{folder} AS d")
    one = parts.selectExpr(f"{PATH} AS path", f"{LANGUAGE} AS language")
    two = parts.where("k % 7 = 0").selectExpr(f"{OTHER_PATH} AS path", f"{LANGUAGE} AS language")
    return one.unionByName(two)


def statements(t: Tables, *languages: str, folder: str = FOLDER) -> DataFrame:
    """src, language, spec of every line whose part is of one of the languages."""
    wanted = [LANGUAGES.index(name) for name in languages]
    parts = t.read("part").selectExpr("p_partkey AS k", f"{folder} AS d")
    count = t.read("part").agg(F.count(F.lit(1))).scalar()
    lines = t.read("lineitem").where((F.col("l_partkey") % 4).isin(wanted)).withColumn("parts", count)
    named = lines.selectExpr(
        "l_partkey AS s", f"{TARGET} AS t", "l_linenumber AS n", f"{GONE} AS gone"
    )
    source = parts.selectExpr("k AS s", f"{PATH} AS src", f"{LANGUAGE} AS language")
    target = parts.selectExpr("k AS t", "d AS td")
    return named.join(source, "s").join(target, "t").selectExpr("src", "language", f"{SPEC} AS spec")


def links(t: Tables, *languages: str, folder: str = FOLDER) -> Links:
    return modules.resolve_links(statements(t, *languages, folder=folder), files(t, folder), GO_MODULE)


# Without a module's name: imports end in a folder that the repository has, or in one of its
# parents' names only; some packages have a vendored copy, whose folder is the longer one.
VENDORED = "concat('vendored/', regexp_replace(path, '/f([0-9]+)', '/v$1'))"
VENDORED_SQL = "concat('vendored/', regexp_replace(path, '/f([0-9]+)', '/v\\1'))"
FOREIGN = """CASE WHEN spec LIKE '%zz' THEN spec WHEN length(src) % 3 = 0 THEN spec
  WHEN length(src) % 3 = 1 THEN replace(spec, 'example.org/mono', 'host.dev/vendored')
  ELSE replace(spec, 'example.org/mono/go/', '') END"""


def suffix_links(t: Tables) -> Links:
    own = files(t)
    copies = own.where("language = 'go' AND path LIKE '%5.go'").selectExpr(f"{VENDORED} AS path", "language")
    foreign = statements(t, "go").selectExpr("src", "language", f"{FOREIGN} AS spec")
    return modules.resolve_links(foreign, own.unionByName(copies), None)


def edges_of(links_: Links) -> DataFrame:
    return links_.written_out()


def priorities(t: Tables) -> DataFrame:
    return files(t).selectExpr("path", f"{PRIORITY} AS priority")


PRIORITY = "CAST(length(path) * 7 % 23 AS DOUBLE)"

CTES = f"""
WITH p AS (SELECT p_partkey AS k, {FOLDER} AS d FROM part),
f AS (
  SELECT {PATH} AS path, {LANGUAGE} AS language FROM p
  UNION ALL SELECT {OTHER_PATH}, {LANGUAGE} FROM p WHERE k % 7 = 0),
i AS (
  SELECT l_partkey AS s, {TARGET} AS t, l_linenumber AS n, {GONE} AS gone
  FROM lineitem, (SELECT count(*) AS parts FROM part)),
w AS (
  SELECT DISTINCT src, language, {SPEC} AS spec
  FROM i JOIN (SELECT k AS s, {PATH} AS src, {LANGUAGE} AS language FROM p) USING (s)
  JOIN (SELECT k AS t, d AS td FROM p) USING (t)),
py AS (
  SELECT src, CASE WHEN spec LIKE '.%' THEN regexp_replace(src, '/[^/]*$', '') || '/' || substr(spec, 2)
    ELSE replace(spec, '.', '/') END AS m
  FROM w WHERE language = 'python'),
web AS (
  SELECT src, CASE WHEN spec LIKE '../../%' THEN regexp_replace(src, '(/[^/]*)(/[^/]*)(/[^/]*)$', '')
      || substr(spec, 6) ELSE regexp_replace(src, '(/[^/]*)(/[^/]*)$', '') || substr(spec, 3) END AS m
  FROM w WHERE language = 'typescript'),
go AS (SELECT src, substr(spec, 18) AS folder FROM w WHERE language = 'go'),
rs AS (
  SELECT src, CASE WHEN spec LIKE 'crate::%' THEN 'crates/src/' || replace(substr(spec, 8), '::', '/')
    ELSE regexp_replace(regexp_replace(src, '/mod.rs$', '.rs'), '/[^/]*$', '') || '/' || substr(spec, 8)
    END AS m
  FROM w WHERE language = 'rust'),
c AS (
  SELECT 'python' AS language, src, unnest([m || '.py', m || '/__init__.py']) AS dst,
    unnest([1, 2]) AS place, m FROM py
  UNION ALL SELECT 'rust', src, unnest([m || '.rs', m || '/mod.rs']), unnest([1, 2]), m FROM rs
  UNION ALL SELECT 'typescript', src,
    unnest([m, m || '.ts', m || '.js', m || '/index.ts', regexp_replace(m, '\\.js$', '.ts')]),
    unnest([1, 2, 3, 4, 5]), m FROM web),
direct AS (
  SELECT language, src, arg_min(dst, place) AS dst
  FROM c JOIN (SELECT DISTINCT path AS dst FROM f) USING (dst) GROUP BY language, src, m),
gofiles AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path FROM f
  WHERE language = 'go' AND path NOT LIKE '%\\_test.go' ESCAPE '\\'),
e AS (
  SELECT * FROM direct
  UNION ALL SELECT 'go', src, path FROM go JOIN gofiles USING (folder)),
x AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
lanes AS (
  SELECT dst, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS l0,
    sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS l1,
    sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS l2,
    sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)::HUGEINT) AS l3, count(*) AS fan_in
  FROM (SELECT dst, sha256(src) AS h FROM x) GROUP BY dst),
fan_rows AS (
  SELECT path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, l0, l1, l2, l3
  FROM (SELECT DISTINCT path FROM f) LEFT JOIN lanes ON dst = path
  LEFT JOIN (SELECT src, count(*) AS fan_out FROM x GROUP BY src) ON src = path)"""

WIDE_CTES = CTES.replace(FOLDER, WIDE_FOLDER)

FOREIGN_CTES = f"""{CTES},
v AS (
  SELECT folder, path FROM gofiles
  UNION SELECT regexp_replace(path, '/[^/]*$', ''), path
  FROM (SELECT {VENDORED_SQL} AS path FROM f WHERE language = 'go' AND path LIKE '%5.go')),
h AS (SELECT DISTINCT src, {FOREIGN} AS spec FROM w WHERE language = 'go'),
b AS (
  SELECT src, spec, arg_max(folder, length(folder)) AS folder FROM h JOIN (SELECT DISTINCT folder FROM v)
  ON spec = folder OR ends_with(spec, '/' || folder) GROUP BY src, spec)"""

PLANS: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {
    f"resolve_{name}": (
        lambda t, name=name: edges_of(links(t, name)),
        f"{CTES} SELECT DISTINCT src, dst FROM e WHERE src <> dst AND language = '{name}'",
    )
    for name in LANGUAGES
} | {
    "resolve_go": (
        lambda t: edges_of(links(t, "go", folder=WIDE_FOLDER)),
        f"{WIDE_CTES} SELECT DISTINCT src, dst FROM e WHERE src <> dst AND language = 'go'",
    ),
    "resolve_go_by_suffix": (
        lambda t: edges_of(suffix_links(t)),
        f"{FOREIGN_CTES} SELECT DISTINCT src, path AS dst FROM b JOIN v USING (folder) WHERE src <> path",
    ),
    "import_graph": (
        lambda t: edges_of(links(t, *LANGUAGES, folder=WIDE_FOLDER)),
        f"{WIDE_CTES} SELECT DISTINCT src, dst FROM e WHERE src <> dst",
    ),
    "package_members": (
        lambda t: links(t, "go").members,
        f"{CTES} SELECT DISTINCT folder AS package, path FROM gofiles",
    ),
    "package_fans": (
        lambda t: packages.fan_in_out(files(t).distinct(), links(t, *LANGUAGES).stored()),
        f"{CTES} SELECT path, fan_in, fan_out FROM fan_rows",
    ),
    "package_prints": (
        lambda t: packages.graph_fingerprints(files(t).distinct(), links(t, *LANGUAGES).stored()),
        f"""{CTES} SELECT path, substr(sha256(concat_ws('|', fan_out, fan_in, coalesce(l0, 0),
          coalesce(l1, 0), coalesce(l2, 0), coalesce(l3, 0))), 1, 16) AS graph_fingerprint FROM fan_rows""",
    ),
    "package_impact": (
        lambda t: packages.impact_summary(links(t, *LANGUAGES).stored(), priorities(t).distinct()),
        f"""{CTES} SELECT dst AS path, count(*) AS affected,
          arg_min(src, row(-priority, src)) AS top_affected, max(priority) AS top_priority
        FROM x JOIN (SELECT DISTINCT path AS src, {PRIORITY} AS priority FROM f) USING (src) GROUP BY dst""",
    ),
    "package_nearest": (
        lambda t: packages.nearest_edges(links(t, *LANGUAGES).stored(), 3)[1],
        f"""{CTES} SELECT src, dst FROM x
        QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 3""",
    ),
}


# Source texts made from a part's name and key, and what a reader finds in them. w: the first word
# of the name. Comments hold statements that are none.
TEXTS = {
    "python": (
        """concat('# import ', w, '\\nimport os, ', w, '.m', k, ' as x\\n',
          'from .p', k % 9, ' import q\\nfrom . import (r, s as t)\\n',
          CASE WHEN k % 2 = 0 THEN concat('async def f', k, '(): pass\\n') ELSE '' END,
          'class C', k, ':\\n  def inner(self): pass\\nclass _H: pass\\n')""",
        "concat('os,', w, '.m', k, ',.p', k % 9, ',.r,.s')",
        "concat('C', k, CASE WHEN k % 2 = 0 THEN concat(',f', k) ELSE '' END)",
    ),
    "go": (
        """concat('package ', w, '\\n// import \"none\"\\nimport (\\n  \"fmt\"\\n  a \"x.org/', w, '/', k % 9,
          '\"\\n)\\nimport \"os\"\\nfunc F', k, '() {}\\nfunc (t *T) M', k, '() {}\\n',
          CASE WHEN k % 2 = 0 THEN concat('type T', k, ' int\\n') ELSE 'type\\nT int\\n' END,
          'var low = 1\\nconst Big', k, ' = 2\\n')""",
        "concat('fmt,x.org/', w, '/', k % 9, ',os')",
        """concat('Big', k, ',F', k, ',M', k, CASE WHEN k % 2 = 0 THEN concat(',T', k) ELSE '' END)""",
    ),
    "rust": (
        """concat('/* use none::x; */\\nuse crate::', w, '::{A', k, ', b as c};\\nmod m', k % 9, ';\\n',
          'pub(crate) async fn f', k, '() {}\\n', CASE WHEN k % 2 = 0 THEN concat('  pub struct S', k, ';\\n')
          ELSE 'pub\\nstruct S;\\n' END, 'fn hidden() {}\\n')""",
        "concat('crate::', w, '::A', k, ',crate::', w, '::b,mod:m', k % 9)",
        "concat(CASE WHEN k % 2 = 0 THEN concat('S', k, ',') ELSE '' END, 'f', k)",
    ),
}
NAMED = "p_partkey AS k, split_part(p_name, ' ', 1) AS w"


def facts(t: Tables, language: str) -> DataFrame:
    named = t.read("part").select(
        F.col("p_partkey").alias("k"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")
    )
    units = named.selectExpr(
        "k", f"{TEXTS[language][0]} AS content", f"'{language}' AS language"
    )
    return modules.with_modules(units).select(
        "k", F.array_join("specifiers", ",").alias("specifiers"),
        F.array_join("exports", ",").alias("exports"),
    )


for _language, (_, _specifiers, _exports) in TEXTS.items():
    PLANS[f"module_facts_{_language}"] = (
        lambda t, language=_language: facts(t, language),
        f"SELECT k, {_specifiers} AS specifiers, {_exports} AS exports FROM (SELECT {NAMED} FROM part)",
    )
