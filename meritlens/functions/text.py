"""Text functions: tokens, term coverage, keywords, spans, year bands, places."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlens.functions import lexicons as lx

#: Token patterns of the three channels.
COVERAGE_TOKEN = "[a-z0-9+#]+"
MATCH_TOKEN = r"[a-z0-9+#./\-]{3,}"
BASELINE_TOKEN = "[a-z0-9+#./]+"
KEYWORD_TOKEN = r"[a-zA-Z][a-zA-Z0-9+#/.\-]*|[.][a-zA-Z]+"
YEARS_BAND = r"(\d{1,2})\s*(?:[-–]|to)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?|y)\b"
YEARS_FROM = r"(\d{1,2})\s*\+\s*(?:years?|yrs?|y)\b"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: Sequence[str]) -> Column:
    """A literal array of strings (also when empty)."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def norm(c: Column | str) -> Column:
    """Lower-case without white space at the ends; null counts as empty."""
    return F.lower(F.trim(F.coalesce(as_column(c), F.lit(""))))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), r"\s+", " "))


def token_set(c: Column | str, pattern: str = COVERAGE_TOKEN) -> Column:
    """Distinct tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(as_column(c), F.lit(""))), F.lit(f"({pattern})"), 1))


def contains_any(c: Column | str, terms: Sequence[str]) -> Column:
    """The terms that occur anywhere in the text (also inside words), sorted."""
    text = F.coalesce(as_column(c), F.lit(""))
    return F.filter(strings(sorted(terms)), lambda t: F.contains(text, t))


def term_words(term: str) -> list[str]:
    """The words of a term that count for coverage."""
    return [w for w in re.split(r"[\s/\-]+", term.lower()) if len(w) >= 3 or w in lx.SHORT_SKILLS]


def coverage_of(tokens: Column | str, terms: Column) -> Column:
    """:func:`term_coverage` of terms that stand in a column, each as the list of its words (:func:`term_words`)."""
    have = as_column(tokens)

    def credit(words: Column) -> Column:
        hits = F.size(F.filter(words, lambda w: F.array_contains(have, w)))
        enough = F.when(F.size(words) == 1, hits >= 1).otherwise((hits >= 2) | (hits / F.size(words) >= 0.6))
        return F.when(F.size(words) == 0, 0.0).when(enough, 1.0).when(hits >= 1, 0.4).otherwise(0.0)

    total = F.aggregate(F.transform(terms, credit), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(F.size(terms) > 0, total / F.size(terms)), F.lit(0.0))


def term_coverage(tokens: Column | str, terms: Sequence[str]) -> Column:
    """Mean credit of the terms over a token set.

    One word found counts 1 for a one-word term; two words or 60 % of them count 1 for a longer one
    and a single word 0.4.  Terms without countable words stay in the mean with credit 0."""
    if not terms:
        return F.lit(0.0)
    have = as_column(tokens)
    credits = F.lit(0.0)
    for words in map(term_words, terms):
        if not words:
            continue
        hits = F.size(F.filter(strings(words), lambda w: F.array_contains(have, w)))
        enough = (hits >= 1) if len(words) == 1 else (hits >= 2) | (hits / len(words) >= 0.6)
        credits = credits + F.when(enough, 1.0).when(hits >= 1, 0.4).otherwise(0.0)
    # never null, so that joins on what is made of it need no filter that would repeat the work
    return F.coalesce(credits / F.lit(float(len(terms))), F.lit(0.0))


def keywords(c: Column | str, limit: int = 6) -> Column:
    """The first distinct telling words of a sentence, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(as_column(c), F.lit(""))), F.lit(f"({KEYWORD_TOKEN})"), 1)
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"^[-/]+|[-/]+$", ""))
    short, stop = strings(lx.SHORT_SKILLS), strings(lx.STOPWORDS)
    kept = F.filter(
        bare, lambda t: ((F.length(t) >= 3) | F.array_contains(short, t)) & ~F.array_contains(stop, t)
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def keywords_of(sentence: str, limit: int = 6) -> tuple[str, ...]:
    """:func:`keywords` of one string on the driver (requirement texts)."""
    out: dict[str, None] = {}
    for token in re.findall(KEYWORD_TOKEN, sentence.lower()):
        token = token.strip("-/")
        if (len(token) >= 3 or token in lx.SHORT_SKILLS) and token not in lx.STOPWORDS:
            out[token] = None
    return tuple(out)[:limit]


def matched_keywords(words: Column, tokens: Column | str) -> Column:
    """The keywords that are tokens, in keyword order."""
    have = as_column(tokens)
    return F.filter(words, lambda k: F.array_contains(have, k))


def lexical_overlap(words: Column, tokens: Column | str) -> Column:
    """Share of the keywords that are tokens; 0 without keywords."""
    n = F.size(words)
    return F.when(n > 0, F.size(matched_keywords(words, tokens)) / n).otherwise(0.0)


def best_span(words: Column, text: Column | str, most: int = 160) -> Column:
    """The sentence with most keywords (the shorter, then the earlier of equals), cut to length.

    Sentences of under 12 characters do not count; without a keyword the span is empty."""
    pieces = F.split(F.coalesce(as_column(text), F.lit("")), r"(?<=[.!?])\s+|\n+")
    bare = F.transform(pieces, lambda s: F.trim(s))
    rated = F.transform(
        bare,
        lambda s, i: F.struct(
            F.size(F.array_intersect(words, token_set(s, MATCH_TOKEN))).alias("hits"),
            (-F.length(s)).alias("short"),
            (-i).alias("early"),
            s.alias("s"),
        ),
    )
    best = F.array_max(F.filter(rated, lambda x: (-x["short"] >= 12) & (x["hits"] > 0)))
    cut = F.when(F.length(best["s"]) > most, F.concat(F.substring(best["s"], 1, most - 1), F.lit("…"))).otherwise(best["s"])
    return F.coalesce(cut, F.lit(""))


def year_band(c: Column | str) -> Column:
    """struct(low, high) of the first ``a-b years``, else (a, null) of ``a+ years``, else nulls."""
    text = F.lower(F.coalesce(as_column(c), F.lit("")))
    a, b = (F.regexp_extract(text, YEARS_BAND, k).try_cast("double") for k in (1, 2))
    at_least = F.regexp_extract(text, YEARS_FROM, 1).try_cast("double")
    return F.struct(
        F.when(a.isNotNull(), F.least(a, b)).otherwise(at_least).alias("low"),
        F.when(a.isNotNull(), F.greatest(a, b)).alias("high"),
    )


def places(c: Column | str) -> Column:
    """Cities named in the text, in the list's order."""
    text = F.coalesce(as_column(c), F.lit(""))
    named = lambda city: F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), city, F.lit(r"\b")))
    some = F.regexp_like(text, F.lit(rf"(?i)\b({'|'.join(lx.CITIES)})\b"))  # one constant pattern settles most texts
    return F.when(some, F.filter(strings(lx.CITIES), named)).otherwise(F.array().cast("array<string>"))


def account_name(c: Column | str) -> Column:
    """The user of the first code-hosting link, or null (service pages are no users)."""
    reserved = strings(lx.RESERVED_ACCOUNTS)
    name = F.regexp_extract(F.coalesce(as_column(c), F.lit("")), r"(?i)github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})", 1)
    return F.when((name != "") & ~F.array_contains(reserved, F.lower(name)), name)


def fingerprint(*columns: Column) -> Column:
    """Digest of a row's scored fields."""
    return F.sha1(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))))
