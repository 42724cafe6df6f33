"""Comments and strings of source texts as column expressions.

One pattern matches a language's comments and strings. As a scan for it goes on after each match, a
quote inside a comment opens no string and a comment mark inside a string opens no comment. What
lies between the matches is code; matches are blanked in place, so lines and columns keep their
numbers, and put back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs are possessive and unrolled: a long comment or string costs one look at each character.
_QUOTED = {
    "triple": r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+(?:"""|\\?\z)'
    r"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+(?:'''|\\?\z)",
    "double": r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)',
    "single": r"'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)",
    "back": r"`[^`\\]*+(?:\\.[^`\\]*+)*+(?:`|\\?\z)",
}
_SLASHES = [r"/\*.*?(?:\*/|\z)", r"//[^\n]*+"]

# Comments and quotes of each language.
LANGUAGES = {
    "python": ([r"#[^\n]*+"], ["triple", "double", "single", "back"]),
    "go": (_SLASHES, ["double", "single", "back"]),
    "rust": (_SLASHES, ["double", "back"]),
    "typescript": (_SLASHES, ["double", "single", "back"]),
}

# What starts a function, what counts as a decision, what opens a block.
FUNCTION_STARTS = {
    "go": r"^\s*func\s",
    "rust": r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?fn\s",
    "python": r"^\s*(?:async\s+)?def\s+\w+",
}
DECISIONS = {
    "go": (r"if|for|case|select", r"&&|\|\|"),
    "rust": (r"if|match|for|while|loop", r"&&|\|\||\?"),
    "python": (r"if|elif|for|while|except|and|or", None),
}
BLOCK_STARTS = r"^\s*(?:if|elif|else|for|while|try|except|finally|with|match|case)\b"


def tokens_pattern(language: str) -> str:
    comments, quotes = LANGUAGES[language]
    return "(?s)" + "|".join([*comments, *(_QUOTED[kind] for kind in quotes)])


def decision_count(content: Column, language: str) -> Column:
    words, marks = DECISIONS[language]
    pattern = rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
    return F.regexp_count(content, F.lit(pattern if marks is None else f"{pattern}|{marks}"))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _blank_string(token: Column, language: str) -> Column:
    """All but the opening quote; an escape goes as a whole, an escaped line break included."""
    width = F.lit(1)
    if language == "python":
        width = F.when(token.startswith('"""') | token.startswith("'''"), F.lit(3)).otherwise(width)
    body = F.substring(token, width + 1, F.length(token))
    blanked = _blank(F.regexp_replace(body, r"(?s)\\.", "  "))
    return F.concat(F.substring(token, F.lit(1), width), blanked)


def code_of(content: Column, language: str, strings: bool = False) -> Column:
    """The text with its comments blanked, and with ``strings`` its strings as well; templates of
    scripts are blanked always."""
    pattern = tokens_pattern(language)

    def blanked(token: Column) -> Column:
        comment = token.startswith("#") if language == "python" else token.startswith("/")
        if strings:
            return F.when(comment, _blank(token)).otherwise(_blank_string(token, language))
        out = F.when(comment, _blank(token))
        if language == "typescript":
            out = out.when(token.startswith("`"), _blank_string(token, language))
        return out.otherwise(token)

    gaps = F.split(content, pattern, -1)
    tokens = F.regexp_extract_all(content, F.lit(pattern), 0)
    pieces = F.zip_with(
        gaps, tokens, lambda gap, token: F.concat(gap, F.coalesce(blanked(token), F.lit("")))
    )
    return F.when(content.isNotNull(), F.array_join(pieces, ""))


def code(content: Column, language: Column, strings: bool = False) -> Column:
    """:func:`code_of` by the language of the row; null for other languages."""
    out = F.lit(None).cast("string")
    for name in LANGUAGES:
        out = F.when(language == name, code_of(content, name, strings)).otherwise(out)
    return out
