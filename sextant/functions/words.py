"""Word matching for the bounded lists the driver holds (intent, candidates)."""

from __future__ import annotations

import re

from sextant.functions.text import MIN_PREFIX, MIN_TOKEN, STOPWORDS


# Punctuation in collation order, ahead of digits and letters.
_PUNCTUATION = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"
_RANKS = {mark: at for at, mark in enumerate(" " + _PUNCTUATION + "0123456789")}


def locale_key(path: str) -> tuple:
    """Sort key of short lists with the order of :func:`paths.in_locale_order` for ASCII."""
    lowered = path.lower()
    primary = tuple(_RANKS.get(mark, 100 + ord(mark)) for mark in lowered)
    return primary, tuple(mark.isupper() for mark in path), path


def words(text: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower()
    return [word for word in re.split(r"[^a-z0-9]+", spaced) if len(word) >= MIN_TOKEN]


def query_words(text: str) -> list[str]:
    return list(dict.fromkeys(word for word in words(text) if word not in STOPWORDS))


def symbol_words(path: str, exports: list[str]) -> set[str]:
    return set(words(path)).union(*(words(symbol) for symbol in exports))


def _pair(term: str, word: str) -> bool:
    if term == word:
        return True
    short, long = sorted((term, word), key=len)
    return len(short) >= MIN_PREFIX and long.startswith(short)


def matched(terms: list[str], target: set[str]) -> int:
    return sum(any(_pair(term, word) for word in target) for term in terms)
