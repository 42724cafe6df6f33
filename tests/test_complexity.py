"""Complexity from line and scope tables against a stack machine on random code."""

import random
import re

import pytest

from sextant.functions.lexer import code_of
from sextant.operators.complexity import COUNTERS, complexity

DECIDE = {
    "go": r"\b(?:if|for|case|select)\b|&&|\|\|", "rust": r"\b(?:if|match|for|while|loop)\b|&&|\|\||\?",
    "python": r"\b(?:if|elif|for|while|except|and|or)\b",
}
START = {
    "go": r"\s*func\s", "rust": r"\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?fn\s",
    "python": r"\s*(?:async\s+)?def\s+\w+",
}
BLOCK = r"\s*(?:if|elif|else|for|while|try|except|finally|with|match|case)\b"


def blanked(source, language, strings):
    """Character by character."""
    line, quotes = {"python": ("#", "\"'`"), "rust": ("//", '"`')}.get(language, ("//", "\"'`"))
    out, i, quote = [], 0, None
    while i < len(source):
        if quote:
            if source[i] == "\\":
                out.append(" " * len(source[i : i + 2]) if strings else source[i : i + 2])
                i += 2
            elif source.startswith(quote, i):
                out.append(" " * len(quote) if strings else quote)
                i += len(quote)
                quote = None
            else:
                out.append(source[i] if not strings or source[i] == "\n" else " ")
                i += 1
        elif source[i] in quotes:
            triple = language == "python" and source[i] != "`" and source.startswith(source[i] * 3, i)
            quote = source[i] * (3 if triple else 1)
            out.append(quote)
            i += len(quote)
        elif source.startswith(line, i) or language != "python" and source.startswith("/*", i):
            block = source.startswith("/*", i)
            end = source.find("*/" if block else "\n", i + 2 * block)
            end = len(source) if end < 0 else end + 2 * block
            out.append(re.sub(r"[^\n]", " ", source[i:end]))
            i = end
        else:
            out.append(source[i])
            i += 1
    return "".join(out)


def braces(source, language):
    lines = blanked(source, language, True).split("\n")
    stack, root, functions, done, pending = [], 1, 0, [], False
    for n, text in enumerate(lines):
        if re.match(START[language], text):
            functions, pending = functions + 1, True
        count = len(re.findall(DECIDE[language], text))
        own = [f for f in stack if f[0]]
        if own:
            own[-1][2] += count
        else:
            root += count
        for c in text:
            if c == "{":
                stack.append([pending, n, 1])
                pending = False
            elif c == "}" and stack:
                depth, f = len(stack), stack.pop()
                if f[0]:
                    done.append((f[2], depth, n - f[1] + 1))
    return result(functions, root, done)


def indents(source):
    lines = [(n, t) for n, t in enumerate(blanked(source, "python", True).split("\n")) if t.strip()]
    stack, blocks, root, functions, done, last = [], [], 1, 0, [], 0
    for n, text in lines:
        indent = len(text) - len(text.lstrip())
        while stack and indent <= stack[-1][0]:
            f = stack.pop()
            done.append((f[2], f[3], last - f[1] + 1))
        while blocks and indent <= blocks[-1]:
            blocks.pop()
        last = n
        if re.match(START["python"], text):
            stack.append([indent, n, 1, 0])
            functions += 1
            continue
        count = len(re.findall(DECIDE["python"], text))
        if stack:
            stack[-1][2] += count
        else:
            root += count
        if re.match(BLOCK, text):
            blocks.append(indent)
            if stack:
                stack[-1][3] = max(stack[-1][3], len(blocks))
    done += [(f[2], f[3], last - f[1] + 1) for f in stack]
    return result(functions, root, done)


def result(functions, root, done):
    return (
        functions, root + sum(d[0] for d in done), max([root, *(d[0] for d in done)]),
        max([0, *(d[1] for d in done)]), max([0, *(d[2] for d in done)]),
    )


PIECES = {
    "go": ["func f() {", "}", "{", "if a && b {", "} else if c || d {", "for {", "x := 1", "// if {", 's := "} if"',
           "/* for {", "*/ }", "case 1:", "func (t T) g()", "`a\n{ if`", "'{'", "func h() { if x { y() } }", '"\\" {"', "  "],
    "rust": ["fn f() {", "}", "{", "if a && b? {", "match x {", "while y {", "loop {", "let x = 'a';", "// }", '"} {"',
             "/* if", "*/", "pub async fn g() -> T {", "unsafe fn h();", '"\\\\" {', '"open', 'end"', "  "],
    "python": ["def f():", "async def g():", "if a and b:", "elif c or d:", "else:", "for x in y:", "while z:", "try:",
               "except E:", "x = 1", "# if", "s = 'if # no'", '"""if', 'end """', "with a as b:", "", "match x:",
               "class C:", "'''a' \"\"\" '''", "x = 'it\\'s if'", "`if`", '"""a\\""" if"""'],
}


def programs(language, seed):
    rng = random.Random(seed)
    out = ["", "\n\n", None, PIECES[language][0], '"', "'", '"\\', '"""', "/*", "#"]
    for _ in range(150):
        lines = []
        for _ in range(rng.choice([1, 4, 15, 60])):
            lines.append(" " * rng.choice([0, 0, 2, 4, 4, 6, 8]) + rng.choice(PIECES[language]))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("language", ["go", "rust", "python"])
def test_complexity_matches_a_stack_machine(spark, language):
    sources = programs(language, 5)
    rows = [(f"f{i}", s) for i, s in enumerate(sources)]
    files = spark.createDataFrame(rows, "path string, content string").repartition(3)
    found = {r["path"]: tuple(r[c] for c in COUNTERS) for r in complexity(files, language).collect()}
    model = indents if language == "python" else lambda s: braces(s, language)
    for path, source in rows:
        assert found[path] == model(source or ""), source


@pytest.mark.parametrize("language", ["go", "rust", "python"])
@pytest.mark.parametrize("strings", [False, True])
def test_blanked_text_keeps_every_place(spark, language, strings):
    sources = [s for s in programs(language, 6) if s is not None]
    files = spark.createDataFrame([(s,) for s in sources], "s string")
    for row in files.select("s", code_of(files["s"], language, strings).alias("code")).collect():
        assert row["code"] == blanked(row["s"], language, strings), row["s"]


def test_templates_of_scripts_are_blanked(spark):
    files = spark.createDataFrame([("a = `x // y`; // z\n'b'",)], "s string")
    assert files.select(code_of(files["s"], "typescript")).first()[0] == "a = `       ;     \n'b'"


def test_long_texts(spark):
    long = "x = '" + "a\\'" * 200_000 + "'\n/*" + "b\n" * 200_000 + "*/ if" + '"' + "c" * 500_000
    files = spark.createDataFrame([("p", long)], "path string, content string")
    found = complexity(files, "go").first()
    assert found["total_cyclomatic"] == 2
    nested = "\n".join("if x:".rjust(i + 5) for i in range(400))
    files = spark.createDataFrame([("p", "def f():\n" + nested.replace("\n", "\n ").join([" ", ""]))], "path string, content string")
    assert complexity(files, "python").first()["max_nesting"] == 400


def test_empty_table(spark):
    files = spark.createDataFrame([], "path string, content string")
    for language in ("go", "python"):
        assert complexity(files, language).collect() == []
