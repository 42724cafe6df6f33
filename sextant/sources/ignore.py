"""Ignore files (gitignore syntax) as one column predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions import paths as P

IGNORE_FILES = [".gitignore", ".sextantignore"]


@dataclass(frozen=True)
class Rule:
    pattern: str  # regular expression over a path; directories end in a slash
    keeps: bool  # a negated line brings a path back


def _glob(text: str) -> str:
    out, at = "", 0
    while at < len(text):
        if text.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif text.startswith("**", at):
            out, at = out + ".*", at + 2
        elif text[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif text[at] == "?":
            out, at = out + "[^/]", at + 1
        elif text[at] == "[" and "]" in text[at + 2:]:
            end = text.index("]", at + 2)
            body = text[at + 1:end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            at = end + 1
        elif text[at] == "\\" and at + 1 < len(text):
            out, at = out + re.escape(text[at + 1]), at + 2
        else:
            out, at = out + re.escape(text[at]), at + 1
    return out


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", raw)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        lead = "^" if anchored else "^(?:.*/)?"
        rules.append(Rule(f"{lead}{body}{'/' if folder else '/?'}$", keeps))
    return rules


def load_rules(root: str) -> list[Rule]:
    """Rules of the ignore files at the root, in reading order."""
    rules: list[Rule] = []
    for name in IGNORE_FILES:
        file = Path(root) / name
        if file.is_file():
            rules += parse_rules(file.read_text(encoding="utf-8", errors="replace"))
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """The last matching rule decides, and an ignored directory takes all below it along."""
    if not rules:
        return F.lit(False)

    def decided(entry: Column) -> Column:
        verdict = F.lit(False)
        for rule in rules:
            verdict = F.when(entry.rlike(rule.pattern), F.lit(not rule.keeps)).otherwise(verdict)
        return verdict

    levels = P.prefixes(path)
    entries = F.transform(
        levels, lambda level, at: F.when(at < F.size(levels) - 1, F.concat(level, F.lit("/")))
        .otherwise(level)
    )
    return F.exists(entries, decided)
