"""Source texts made of line items: each part is a file, each of its lines a line of code that its
numbers choose from a language's pieces. Comments hold code and quotes, strings hold comment marks.

The SQL blanks comments and strings, splits lines and matches scopes by joins of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import modules
from sextant.operators.complexity import COUNTERS, complexity
from sextant.sources.bindings import Tables

PIECES = {
    "python": [
        "def f{k}(a):", "if a and b:", "for x in a:", "x = 'if # {k}'", "# if 'quoted", "return x",
        "import os, p{k} as q", "from .m{k} import n, o", "from . import (r{k}, s as t)", "else:",
        "class C{k}:", '"""', "while x or y:", "try:", "async def g{k}():", "s = \"def 'no' # {k}\"",
        "from pkg.u{k} import v", "with a as b:", "x = 'it\\'s' if x else y",
    ],
    "go": [
        "func F{k}() {", "}", "if a && b {", "} else if c || d {", "for {", "x := 1 // if {", 's := "} // {"',
        "/* for { \"", "*/ }", 'import "pkg/a{k}"', 'import (', 'b "x.org/{k}"', ")", "type T{k} struct {", "case 1:",
        "func (t *T) M{k}() {", "}", "const Big{k} = '{'", "}",
    ],
    "rust": [
        "fn f{k}() {", "}", "if a && b? {", "match x {", "while y {", "// } \"", 'let s = "{ // if \\" {";', "}",
        "/* use no::one; \"", "*/", "use crate::a{k}::{b, c as d};", "mod m{k};", "pub struct S{k};", "}",
        "pub async fn g{k}() -> T {", "use std::x{k};", "loop {", "}", "pub(crate) enum E{k} {",
    ],
}

# Expressions that both engines read alike.
KIND = "(l_orderkey * 7 + l_linenumber * 5 + l_suppkey) % {n} + 1"
INDENT = "CAST((l_suppkey + l_linenumber * 3) % 5 AS INT)"
NUMBER = "CAST(l_orderkey % 23 AS STRING)"


def sources(t: Tables, language: str) -> DataFrame:
    """path, content: one text for each part that has lines."""
    pieces = F.array(*(F.lit(piece) for piece in PIECES[language]))
    kind = F.expr(KIND.format(n=len(PIECES[language]))).cast("int")
    piece = F.replace(F.element_at(pieces, kind), F.lit("{k}"), F.expr(NUMBER))
    line = F.concat(F.repeat(F.lit("  "), F.expr(INDENT)), piece)
    lines = t.read("lineitem").select(
        "l_partkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey", line.alias("text")).alias("row")
    )
    texts = lines.groupBy("l_partkey").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return texts.select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("path"),
        F.array_join("rows.text", "\n").alias("content"),
    )


def facts(t: Tables, language: str) -> DataFrame:
    found = modules.with_modules(sources(t, language).withColumn("language", F.lit(language)))
    return found.select(
        "path", F.array_join(F.array_sort("specifiers"), ",").alias("imports"),
        F.array_join("exports", ",").alias("exports"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The pattern of comments and strings without look-ahead.
_STRING = r'"(?:[^"\\]|\\.)*(?:"|\\?\z)'
_TOKENS = {
    "python": r"(?s)#[^\n]*|"
    r'"""(?:[^"\\]|\\.|"[^"\\]|"\\.|""[^"\\]|""\\.)*(?:"""|"{0,2}\\?\z)|'
    r"'''(?:[^'\\]|\\.|'[^'\\]|'\\.|''[^'\\]|''\\.)*(?:'''|'{0,2}\\?\z)|"
    + _STRING + r"|'(?:[^'\\]|\\.)*(?:'|\\?\z)|`(?:[^`\\]|\\.)*(?:`|\\?\z)",
    "go": r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*|" + _STRING + r"|'(?:[^'\\]|\\.)*(?:'|\\?\z)|`(?:[^`\\]|\\.)*(?:`|\\?\z)",
    "rust": r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*|" + _STRING + r"|`(?:[^`\\]|\\.)*(?:`|\\?\z)",
}
_BLANK = "regexp_replace({0}, '[^\\n]', ' ', 'g')"


def _texts(language: str) -> str:
    pieces = "[" + ", ".join(map(_quoted, PIECES[language])) + "]"
    kind = KIND.format(n=len(PIECES[language]))
    pattern = _quoted(_TOKENS[language])
    mark = "#" if language == "python" else "/"
    wide = "tok LIKE '\"\"\"%' OR tok LIKE '''''''%'" if language == "python" else "false"
    body = _BLANK.format("regexp_replace(substr(tok, w + 1), '(?s)\\\\.', '  ', 'g')")
    return f"""
t AS (
  SELECT 'part_' || l_partkey AS path, string_agg(
    repeat('  ', {INDENT}) || replace(({pieces})[{kind}], '{{k}}', {NUMBER.replace("STRING", "VARCHAR")}),
    chr(10) ORDER BY l_orderkey, l_linenumber, l_suppkey) AS content
  FROM lineitem GROUP BY l_partkey),
tok AS (
  SELECT path, pos, tok, CASE WHEN {wide} THEN 3 ELSE 1 END AS w, tok LIKE '{mark}%' AS comment
  FROM (SELECT path, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
    FROM (SELECT path, regexp_extract_all(content, {pattern}) AS toks FROM t))),
gap AS (
  SELECT path, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS pos
  FROM (SELECT path, string_split_regex(content, {pattern}) AS gaps FROM t)),
code AS (
  SELECT path, string_agg(gap || coalesce(CASE WHEN comment THEN {_BLANK.format("tok")} ELSE tok END, ''), ''
      ORDER BY pos) AS plain,
    string_agg(gap || coalesce(CASE WHEN comment THEN {_BLANK.format("tok")}
      ELSE substr(tok, 1, w) || {body} END, ''), '' ORDER BY pos) AS bare
  FROM gap LEFT JOIN tok USING (path, pos) GROUP BY path)"""


_DECISION_SQL = {
    "python": r"\b(?:if|elif|for|while|except|and|or)\b", "go": r"\b(?:if|for|case|select)\b|&&|\|\|",
    "rust": r"\b(?:if|match|for|while|loop)\b|&&|\|\||\?",
}
_START_SQL = {
    "python": r"^\s*(?:async\s+)?def\s+\w+", "go": r"^\s*func\s",
    "rust": r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?fn\s",
}
_BLOCK_SQL = r"^\s*(?:if|elif|else|for|while|try|except|finally|with|match|case)\b"


def _lines(language: str) -> str:
    return f"""
l AS (
  SELECT path, line, text, regexp_matches(text, {_quoted(_START_SQL[language])}) AS starts,
    len(regexp_extract_all(text, {_quoted(_DECISION_SQL[language])})) AS decisions
  FROM (SELECT path, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS line
    FROM (SELECT path, string_split(bare, chr(10)) AS parts FROM code)))"""


_RESULT = """
, each AS (
  SELECT path, 1 + coalesce(sum(decisions), 0) AS cyclomatic, any_value(nesting) AS nesting, any_value(lines) AS lines
  FROM scopes LEFT JOIN owned USING (path, owner) GROUP BY path, owner
  UNION ALL SELECT path, 1 + coalesce(sum(decisions) FILTER (owner IS NULL), 0), 0, 0 FROM owned GROUP BY path)
SELECT path, any_value(functions)::INT AS functions, sum(cyclomatic)::INT AS total_cyclomatic,
  max(cyclomatic)::INT AS max_cyclomatic, max(nesting)::INT AS max_nesting, max(lines)::INT AS max_function_lines
FROM each JOIN (SELECT path, count_if(starts) AS functions FROM l GROUP BY path) USING (path) GROUP BY path"""


def _brace_sql(language: str) -> str:
    return f"""WITH {_texts(language)}, {_lines(language)},
b AS (
  SELECT path, line, pos, c, row_number() OVER (PARTITION BY path ORDER BY line, pos) AS seq
  FROM (SELECT path, line, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos
    FROM (SELECT path, line, regexp_extract_all(text, '[{{}}]') AS cs FROM l))),
s AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY seq) AS total FROM b),
d AS (
  SELECT *, total - least(0, min(total) OVER (PARTITION BY path ORDER BY seq)) AS depth,
    coalesce(max(line) FILTER (c = '{{') OVER (PARTITION BY path ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opened FROM s),
f AS (
  SELECT path, seq, line, depth FROM d WHERE c = '{{' AND EXISTS (
    SELECT 1 FROM l WHERE l.path = d.path AND l.starts AND l.line <= d.line AND l.line > d.opened)),
z AS (
  SELECT f.path, f.seq AS owner, f.line, any_value(f.depth) AS nesting, arg_min(e.line, e.seq) AS closed
  FROM f LEFT JOIN d e ON e.path = f.path AND e.seq > f.seq AND e.depth < f.depth GROUP BY ALL),
scopes AS (SELECT path, owner, nesting, closed - line + 1 AS lines FROM z WHERE closed IS NOT NULL),
owned AS (
  SELECT l.path, l.line, any_value(l.decisions) AS decisions, max(z.owner) AS owner
  FROM l LEFT JOIN z ON z.path = l.path AND z.line < l.line AND (z.closed IS NULL OR z.closed >= l.line)
  GROUP BY 1, 2){_RESULT}"""


INDENT_SQL = f"""WITH {_texts("python")}, {_lines("python")},
n AS (
  SELECT *, length(text) - length(regexp_replace(text, '^\\s+', '')) AS indent,
    NOT starts AND regexp_matches(text, {_quoted(_BLOCK_SQL)}) AS block,
    lag(line) OVER (PARTITION BY path ORDER BY line) AS ended, max(line) OVER (PARTITION BY path) AS last
  FROM l WHERE regexp_matches(text, '\\S')),
z AS (
  SELECT h.path, h.line, h.starts, h.block, min(e.line) AS stop,
    coalesce(arg_min(e.ended, e.line), any_value(h.last)) AS until
  FROM n h LEFT JOIN n e ON e.path = h.path AND e.line > h.line AND e.indent <= h.indent
  WHERE h.starts OR h.block GROUP BY ALL),
m AS (
  SELECT n.path, n.line, any_value(CASE WHEN n.starts THEN 0 ELSE n.decisions END) AS decisions,
    any_value(n.block) AS block, max(z.line) FILTER (z.starts AND z.line < n.line) AS owner,
    count(z.line) FILTER (z.block) AS open
  FROM n LEFT JOIN z ON z.path = n.path AND z.line <= n.line AND (z.stop IS NULL OR z.stop > n.line)
  GROUP BY 1, 2),
owned AS (SELECT path, owner, decisions FROM m UNION ALL SELECT DISTINCT path, NULL::BIGINT, 0 FROM l),
scopes AS (
  SELECT path, z.line AS owner, coalesce((SELECT max(open) FROM m WHERE m.path = z.path AND m.owner = z.line
    AND m.block), 0) AS nesting, until - z.line + 1 AS lines FROM z WHERE starts){_RESULT}"""

_SORTED = "array_to_string(list_sort(list_distinct({0})), ',')"
_NAMES = (
    "list_filter(list_transform(string_split(regexp_replace({0}, '[()]', '', 'g'), ','), lambda x: "
    "regexp_replace(trim(x), '\\s+as\\s+.*$', '')), lambda x: x <> '')"
)
_FACTS = {
    "python": f"""WITH {_texts("python")},
r AS (SELECT path, trim(unnest(string_split(plain, chr(10)))) AS line FROM code),
i AS (
  SELECT path, unnest({_NAMES.format("regexp_extract(line, '^import\\s+(.+)$', 1)")}) AS name FROM r
  WHERE regexp_matches(line, '^import\\s+.')
  UNION ALL SELECT path, unnest(CASE WHEN regexp_matches(module, '^\\.*$')
    THEN list_transform({_NAMES.format("names")}, lambda x: module || x) ELSE [module] END)
  FROM (SELECT path, regexp_extract(line, '^from\\s+([\\w.]*)\\s+import\\s+(.+)$', 1) AS module,
    regexp_extract(line, '^from\\s+([\\w.]*)\\s+import\\s+(.+)$', 2) AS names FROM r
    WHERE regexp_matches(line, '^from\\s+[\\w.]*\\s+import\\s+.'))),
x AS (
  SELECT path, {_SORTED.format("list_filter(regexp_extract_all(plain, '(?m)^(?:(?:async[ \\t]+)?def|class)[ \\t]+(\\w+)', 1), lambda x: x NOT LIKE '\\_%' ESCAPE '\\')")} AS exports
  FROM code)
SELECT path, coalesce((SELECT {_SORTED.format("list(name)")} FROM i WHERE i.path = x.path), '') AS imports, exports
FROM x""",
    "go": f"""WITH {_texts("go")}
SELECT path, {_SORTED.format('''flatten(list_transform(regexp_extract_all(plain,
    'import\\s*(?:\\([\\s\\S]*?\\)|"[^"\\n]*")'), lambda s: regexp_extract_all(s, '"([^"\\n]*)"', 1)))''')} AS imports,
  {_SORTED.format("regexp_extract_all(plain, '(?m)^(?:func(?:[ \\t]*[(][^)\\n]*[)])?|type|var|const)[ \\t]+([A-Z]\\w*)', 1)")} AS exports
FROM code""",
    "rust": f"""WITH {_texts("rust")},
u AS (
  SELECT path, regexp_replace(unnest(regexp_extract_all(plain, '\\buse\\s+([\\s\\S]*?);', 1)),
    '\\bas\\s+\\w+|\\s+', '', 'g') AS named FROM code),
i AS (
  SELECT path, unnest(CASE WHEN contains(named, '{{') THEN list_transform(list_filter(string_split(
      replace(substr(named, strpos(named, '{{') + 1), '}}', ''), ','), lambda x: x <> ''),
      lambda x: replace(substr(named, 1, strpos(named, '{{') - 1), '}}', '') || x)
    WHEN replace(named, '}}', '') = '' THEN [] ELSE [replace(named, '}}', '')] END) AS name FROM u
  UNION ALL SELECT path, 'mod:' || unnest(regexp_extract_all(plain,
    '(?m)^[ \\t]*(?:pub[ \\t]+)?mod[ \\t]+(\\w+)[ \\t]*;', 1)) FROM code),
x AS (
  SELECT path, {_SORTED.format("regexp_extract_all(plain, '(?m)^[ \\t]*pub(?:[ \\t]*[(][^)\\n]*[)])?[ \\t]+(?:async[ \\t]+)?(?:unsafe[ \\t]+)?(?:fn|struct|enum|trait|const|static|type|mod)[ \\t]+(\\w+)', 1)")} AS exports
  FROM code)
SELECT path, coalesce((SELECT {_SORTED.format("list(name)")} FROM i WHERE i.path = x.path), '') AS imports, exports
FROM x""",
}

PLANS: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}
for _language in PIECES:
    PLANS[f"complexity_{_language}"] = (
        lambda t, language=_language: complexity(sources(t, language), language).select("path", *COUNTERS),
        INDENT_SQL if _language == "python" else _brace_sql(_language),
    )
    PLANS[f"code_facts_{_language}"] = (lambda t, language=_language: facts(t, language), _FACTS[_language])
