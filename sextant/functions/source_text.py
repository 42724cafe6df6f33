"""Complexity counters of scripts (TypeScript, JavaScript), a file at a time.

The only per-file Python of the scan: templates and regular expressions of scripts nest, so their
tokens are no regular language. Comments, imports, exports and the complexity of all other languages
are columns, windows and joins. Arrow batches are bounded by bytes, whatever the files' sizes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators.complexity import COUNTERS

EMPTY = (0, 0, 0, 0, 0)
Profile = tuple[int, int, int, int, int]

# --- complexity: TypeScript and JavaScript ----------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<word>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>\d[\w.]*)
    |(?P<mark>=>|\?\.(?!\d)|\?\?=|&&=|\|\|=|\?\?|&&|\|\||\.\.\.|[^\s])""",
    re.DOTALL | re.VERBOSE,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_CLOSERS = {"(": ")", "[": "]", "{": "}"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw"}
_HEADS = {"if", "for", "while", "switch", "catch", "with", "await"}
_OPEN_ENDED = set("=+-*/%<>&|^!~?:,.([{") | {"=>", "&&", "||", "??", "?.", "...", "??=", "&&=", "||="}
_CONTINUES = set("=+-*/%<>&|^?:,.)]};") | {"=>", "&&", "||", "??", "?.", "instanceof", "in", "as"}


class _Unreadable(Exception):
    pass


def _tokens(source: str) -> list[tuple[str, int]]:
    """``(text, line)`` of every token; a template's expressions are put in brackets."""
    out: list[tuple[str, int]] = []
    templates: list[int] = []  # open braces inside each template expression
    at, line, size = 0, 1, len(source)

    def template_part(start: int) -> int:
        nonlocal line
        i = start
        while i < size:
            if source[i] == "\\":
                i += 2
            elif source[i] == "`":
                return i + 1
            elif source.startswith("${", i):
                templates.append(0)
                out.append(("(", line))
                return i + 2
            else:
                line += source[i] == "\n"
                i += 1
        raise _Unreadable

    while at < size:
        char = source[at]
        if char == "`":
            out.append(("''", line))
            at = template_part(at + 1)
            continue
        if templates and char == "}" and templates[-1] == 0:
            templates.pop()
            out.append((")", line))
            at = template_part(at + 1)
            continue
        if templates and char in "{}":
            templates[-1] += 1 if char == "{" else -1
        if char == "/" and not source.startswith(("//", "/*"), at):
            last = out[-1][0] if out else "="
            value = last[0].isalnum() or last[0] in "_$)]}\"'"
            found = _REGEX.match(source, at) if not value or last in _BEFORE_REGEX else None
            if found:
                out.append(("''", line))
                at = found.end()
                continue
        match = _TOKEN.match(source, at)
        if match.lastgroup not in ("space", "comment"):
            out.append((match.group(), line))
        line += match.group().count("\n")
        at = match.end()
    return out


def _brackets(tokens: list[tuple[str, int]]) -> dict[int, int]:
    """Partner of every bracket; anything unbalanced makes the file unreadable."""
    partner, stack = {}, []
    for at, (text, _) in enumerate(tokens):
        if text in _CLOSERS:
            stack.append(at)
        elif text in (")", "]", "}"):
            if not stack or _CLOSERS[tokens[stack[-1]][0]] != text:
                raise _Unreadable
            opened = stack.pop()
            partner[opened], partner[at] = at, opened
    if stack:
        raise _Unreadable
    return partner


class _Script:
    """Functions and nested statements of a script as token intervals."""

    def __init__(self, source: str) -> None:
        self.tokens = _tokens(source)
        self.partner = _brackets(self.tokens)
        self.types = self._type_spans()

    def text(self, at: int) -> str:
        return self.tokens[at][0] if 0 <= at < len(self.tokens) else ""

    def is_word(self, at: int) -> bool:
        text = self.text(at)
        return bool(text) and (text[0].isalpha() or text[0] in "_$#")

    def _new_line(self, at: int) -> bool:
        return at + 1 < len(self.tokens) and self.tokens[at + 1][1] > self.tokens[at][1]

    def run_end(self, at: int, stops: str = ";") -> int:
        """Last token of an expression; line breaks end it where no operator continues it."""
        pending = 0
        while at < len(self.tokens):
            text = self.text(at)
            if text in ")]}":
                return at - 1
            if text == "?":
                pending += 1
            if text == ":" and ":" in stops:
                if pending == 0:
                    return at - 1
                pending -= 1
            elif text in stops:
                return at if text == ";" and stops == ";" else at - 1
            at = self.partner[at] if text in _CLOSERS else at
            done = self._new_line(at) and self.text(at) not in _OPEN_ENDED
            if done and self.text(at + 1) not in _CONTINUES:
                return at
            at += 1
        return len(self.tokens) - 1

    def statement_end(self, at: int) -> int:
        word = self.text(at)
        if word == "{":
            return self.partner[at]
        if word in ("if", "for", "while", "with"):
            head = at + 2 if self.text(at + 1) == "await" else at + 1
            if self.text(head) != "(":
                raise _Unreadable
            end = self.statement_end(self.partner[head] + 1)
            if word == "if" and self.text(end + 1) == "else":
                end = self.statement_end(end + 2)
            return end
        if word == "do":
            end = self.statement_end(at + 1)
            return self.partner.get(end + 2, end)
        if word == "switch":
            return self.partner.get(self.partner.get(at + 1, at) + 1, at)
        if word == "try":
            end = self.partner.get(at + 1, at)
            if self.text(end + 1) == "catch":
                body = end + 2
                body = self.partner[body] + 1 if self.text(body) == "(" else body
                end = self.partner.get(body, body)
            if self.text(end + 1) == "finally":
                end = self.partner.get(end + 2, end)
            return end
        return self.run_end(at)

    def _type_spans(self) -> set[int]:
        """Tokens of type declarations and annotations, which hold no code."""
        spans: set[int] = set()
        for at, (text, _) in enumerate(self.tokens):
            starts = self.text(at - 1) in ("", ";", "}", "export", "declare") or (
                at and self.tokens[at - 1][1] < self.tokens[at][1]
            )
            if text == "type" and starts and self.is_word(at + 1):
                spans.update(range(at, self.run_end(at) + 1))
            elif text == "interface" and starts and self.is_word(at + 1):
                body = at
                while self.text(body) not in ("{", ""):
                    body += 1
                spans.update(range(at, self.partner.get(body, body) + 1))
            elif text in ("const", "let", "var") and self.text(at + 2) == ":":
                spans.update(self._annotation(at + 2))
            elif text == ":" and self._is_function_type(at):
                spans.update(self._annotation(at))
            elif text == "(" and self._is_parameter_list(at):
                inner = at + 1
                while inner < self.partner[at]:
                    if self.text(inner) == ":":
                        span = self._annotation(inner)
                        spans.update(span)
                        inner = span.stop
                    else:
                        inner = self.partner.get(inner, inner) if self.text(
                            inner) in _CLOSERS else inner
                        inner += 1
        return spans

    def _is_function_type(self, at: int) -> bool:
        """A property's function type: it ends at ``=`` or ``;``, where a value would not."""
        close = self.partner.get(at + 1, -1) if self.text(at + 1) == "(" else -1
        if close < 0 or self.text(close + 1) != "=>":
            return False
        back = at - 1
        while back > 0 and self.tokens[back][1] == self.tokens[at][1]:
            if self.text(back) in ("case", "default") or (
                self.text(back) == "?" and self.text(back + 1) != ":"
            ):
                return False
            back -= 1
        return self.text(self._annotation(at).stop) in ("=", ";")

    def _annotation(self, at: int) -> range:
        end = at + 1
        while end < len(self.tokens) and self.text(end) not in (",", "=", ";", ")", "]", "}"):
            end = self.partner[end] + 1 if self.text(end) in _CLOSERS else end + 1
        return range(at, end)

    def _body_after(self, close: int) -> int:
        """Opening brace or arrow after a parameter list, past a return type; -1 for none."""
        at = close + 1
        if self.text(at) == ":":
            at += 1
            if self.text(at) == "{":
                at = self.partner[at] + 1
            while self.text(at) and self.text(at) not in ("{", "=>", ";", ",", ")", "}", "="):
                at = self.partner[at] + 1 if self.text(at) in ("(", "[") else at + 1
        return at if self.text(at) in ("{", "=>") else -1

    def _is_parameter_list(self, at: int) -> bool:
        if self.text(at - 1) in _HEADS:
            return False
        return self._body_after(self.partner[at]) >= 0

    def functions(self) -> list[tuple[int, int]]:
        found = []
        for at, (text, _) in enumerate(self.tokens):
            if at in self.types:
                continue
            if text == "=>":
                end = self.partner[at + 1] if self.text(at + 1) == "{" else self.run_end(
                    at + 1, ",;:")
                found.append((self._arrow_start(at), end))
            elif text == "(" and self.text(at - 1) not in _HEADS:
                body = self._body_after(self.partner[at])
                named = self.is_word(at - 1) or self.text(at - 1) in ("]", ">", "*", "''", '"')
                if body >= 0 and self.text(body) == "{" and named:
                    found.append((self._named_start(at), self.partner[body]))
        return found

    def _arrow_start(self, arrow: int) -> int:
        at = arrow - 1
        while at > 0 and self.text(at) != ")" and not (
            self.is_word(at) and self.text(at - 1) not in (":", ".", "|", "<")
        ):
            at -= 1
        at = self.partner.get(at, at)
        return at - 1 if self.text(at - 1) == "async" else at

    def _named_start(self, at: int) -> int:
        start = at - 1
        while start > 0 and self.text(start) == ">":  # generic parameters
            while start > 0 and self.text(start) != "<":
                start -= 1
            start -= 1
        while start > 0 and self.text(start - 1) in (
            "function", "async", "*", "get", "set", "static", "public", "private", "protected",
        ) and self.tokens[start - 1][1] == self.tokens[start][1]:
            start -= 1
        return start

    def nested(self) -> list[tuple[int, int]]:
        out = []
        for at, (text, _) in enumerate(self.tokens):
            if text in ("if", "for", "while", "do", "switch", "try") and self._is_statement(at):
                out.append((at, self.statement_end(at)))
        return out

    def _is_statement(self, at: int) -> bool:
        if at in self.types or self.text(at - 1) in (".", "?."):
            return False
        if self.text(at) in ("do", "try"):
            return self.text(at + 1) not in (":", "(", ",", "=")
        if self.text(at + 1) != "(" and not (
            self.text(at) == "for" and self.text(at + 1) == "await"
        ):
            return False
        return not (self.text(at) == "while" and self._closes_do(at))

    def _closes_do(self, at: int) -> bool:
        if self.text(at - 1) != "}":
            return False
        return self.text(self.partner[at - 1] - 1) == "do"

    def _starts_clause(self, at: int) -> bool:
        fresh_line = at > 0 and self.tokens[at - 1][1] < self.tokens[at][1]
        return fresh_line or self.text(at - 1) in ("{", "}", ";", ":")

    def decisions(self) -> list[int]:
        out = []
        for at, (text, _) in enumerate(self.tokens):
            if at in self.types:
                continue
            after = self.text(at + 1)
            if text in ("&&", "||", "??"):
                out.append(at)
            elif text == "?" and after not in (":", ")", ",", ";", "=", "}", "]"):
                out.append(at)
            elif text in ("if", "for", "while", "do") and self._is_statement(at):
                out.append(at)
            elif text == "catch" and after in ("(", "{") and self.text(at - 1) == "}":
                out.append(at)
            elif text == "case" and after != ":" and self._starts_clause(at):
                out.append(at)
        return out


def script_profile(source: str) -> Profile:
    """Counters of a script; what cannot be read counts nothing."""
    try:
        script = _Script(source)
        functions = sorted(script.functions(), key=lambda f: (f[0], -f[1]))
        nested, decisions = sorted(script.nested()), script.decisions()
    except (_Unreadable, RecursionError, KeyError):
        return EMPTY

    # Functions are in the order of their starts, so an inner one takes its tokens from the outer.
    owner = np.full(len(script.tokens) + 1, -1)
    for n, (start, end) in enumerate(functions):
        owner[start : end + 1] = n
    cyclomatic = dict.fromkeys(range(-1, len(functions)), 1)
    for at in decisions:
        cyclomatic[int(owner[at])] += 1
    nesting = dict.fromkeys(range(-1, len(functions)), 0)
    open_by_owner: dict[int, list[int]] = {}
    for start, end in nested:
        own = int(owner[start])
        still = [e for e in open_by_owner.get(own, []) if e >= start] + [end]
        open_by_owner[own] = still
        nesting[own] = max(nesting[own], len(still))
    lines = [script.tokens[end][1] - script.tokens[start][1] + 1 for start, end in functions]
    own = [nesting[n] for n in range(len(functions))]
    return (
        len(functions), sum(cyclomatic.values()), max(cyclomatic.values()),
        max(own, default=0), max(lines, default=0),
    )


# --- the UDF ----------------------------------------------------------------------------------------

COUNTER_TYPE = T.StructType([T.StructField(name, T.IntegerType()) for name in COUNTERS])


@F.pandas_udf(COUNTER_TYPE)
def _profiles(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([script_profile(text or "") for text in content], columns=COUNTERS)


def script_complexity(content: Column) -> Column:
    return _profiles(content)
