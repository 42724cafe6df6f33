"""Identifier tokens and symbol matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words an objective is never matched on.
STOPWORDS = [
    "the", "and", "for", "with", "where", "what", "how", "does", "this", "that",
    "into", "from", "are", "its", "use", "used", "using", "about", "which", "when",
]
MIN_TOKEN = 3
MIN_PREFIX = 4


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of an identifier or sentence, camel case split, short ones dropped."""
    spaced = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(spaced, "[^a-z0-9]+"), lambda t: F.length(t) >= MIN_TOKEN)


def query_terms(text: Column) -> Column:
    stop = F.array(*[F.lit(word) for word in STOPWORDS])
    return F.array_distinct(F.array_except(identifier_tokens(text), stop))


def symbol_terms(path: Column, exports: Column) -> Column:
    return F.array_distinct(
        F.concat(identifier_tokens(path), F.flatten(F.transform(exports, identifier_tokens)))
    )


def term_matches(term: Column, tokens: Column) -> Column:
    """Equality, or one is a prefix of the other and that prefix is long enough."""
    return F.exists(
        tokens,
        lambda token: (token == term)
        | ((F.length(term) >= MIN_PREFIX) & F.startswith(token, term))
        | ((F.length(token) >= MIN_PREFIX) & F.startswith(term, token)),
    )


def match_count(terms: Column, tokens: Column) -> Column:
    return F.size(F.filter(terms, lambda term: term_matches(term, tokens)))


def match_label(name: Column, exports: Column, terms: Column) -> Column:
    """Export that matches most terms, the first of them on ties, else the file name."""
    scored = F.transform(
        exports,
        lambda symbol, at: F.struct(
            match_count(terms, identifier_tokens(symbol)).alias("score"),
            (-at).alias("at"),
            symbol.alias("symbol"),
        ),
    )
    best = F.array_max(scored)
    return F.when(F.coalesce(best["score"], F.lit(0)) > 0, best["symbol"]).otherwise(name)
