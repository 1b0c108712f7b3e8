"""Phrase-lexicon matching (B10) and marker patterns.

A category's phrases compile to one literal alternation matched ignoring
case on the lowercased text: substring semantics (no word boundary),
leftmost-first, non-overlapping.  Categories are matched independently, so
a stretch of text can count for two categories.

``any_phrase`` holds whenever any category could match (substring tests
plus the characters that fold to ASCII letters), so it gates the
per-category regex walks without changing any count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.functions import patterns as P


def phrase_regex(phrases: list[str]) -> str:
    return P.java(P.alternation(phrases), ignore_case=True)


# Characters that match an ASCII letter when ignoring case but are left as
# they are by lowercasing: dotless i (U+0131) and long s (U+017F).
_FOLDS_TO_ASCII = r"[\x{131}\x{17F}]"


def any_phrase_of(lowered: Column, phrases: list[str]) -> Column:
    """True whenever a case-insensitive match of any phrase can exist.

    On lowercased text a match either contains the lowercase phrase as a
    plain substring or uses one of the few characters that fold to an ASCII
    letter; substring tests are byte scans, far cheaper than a
    case-insensitive regex alternation.
    """
    if not phrases:
        return F.lit(False)
    test = lowered.rlike(_FOLDS_TO_ASCII)
    for p in phrases:
        test = test | lowered.contains(p)
    return test


def any_phrase(lowered: Column, lexicon: dict[str, list[str]], categories: list[str]) -> Column:
    phrases = [p for c in categories if c in lexicon for p in lexicon[c]]
    return any_phrase_of(lowered, phrases)


def phrase_count(lowered: Column, phrases: list[str]) -> Column:
    return F.regexp_count(lowered, F.lit(phrase_regex(phrases))).cast("long")


def category_counts(
    lowered: Column, lexicon: dict[str, list[str]], categories: list[str]
) -> list[tuple[str, Column]]:
    """``[(category, count)]`` in configured order, gated by ``any_phrase``."""
    hit = any_phrase(lowered, lexicon, categories)
    zero = F.lit(0).cast("long")
    return [
        (c, F.when(hit, phrase_count(lowered, lexicon[c])).otherwise(zero))
        for c in categories
        if c in lexicon
    ]


# Marker patterns: hallucination counts and content-filter tests.
STATISTIC = P.java(P.STATISTIC, ignore_case=True)
ASSERTION = P.java(P.ASSERTION, ignore_case=True)
CITATION = P.java(P.CITATION, ignore_case=True)
HARMFUL_INSTRUCTION = P.java(P.HARMFUL_INSTRUCTION, ignore_case=True, unix_lines=True)
SYSTEM_LEAK = P.java(P.SYSTEM_LEAK, ignore_case=True)


# Literals every match of a marker pattern contains (lowercased): a match
# needs one of them, so their absence from the lowercased text (and of the
# characters that fold to ASCII letters) proves the count is zero.
MARKER_LITERALS: dict[str, list[list[str]]] = {
    STATISTIC: [["%", "studies", "according", "scientists", "fact"]],
    ASSERTION: [["definitely", "always", "never", "every", "without", "undeniably", "guaranteed"]],
    CITATION: [["al.", "journal", "published"]],
    # an opening word and an action verb must both occur
    HARMFUL_INSTRUCTION: [
        ["step", "first", "then", "next", "finally"],
        ["mix", "combine", "inject", "insert", "attach", "connect"],
    ],
    SYSTEM_LEAK: [["prompt", "instruct", "programmed", "told", "message"]],
}


def marker_gate(text: Column, regex: str) -> Column:
    low = F.lower(text)
    gate = None
    for group in MARKER_LITERALS[regex]:
        g = any_phrase_of(low, group)
        gate = g if gate is None else gate & g
    return gate


def marker_count(text: Column, regex: str) -> Column:
    n = F.regexp_count(text, F.lit(regex)).cast("long")
    return F.when(marker_gate(text, regex), n).otherwise(F.lit(0).cast("long"))


def marker_found(text: Column, regex: str) -> Column:
    return marker_gate(text, regex) & text.rlike(regex)
