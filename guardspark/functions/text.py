"""Text column functions.

All are built-in Spark expressions, so they run inside whole-stage codegen on
the executors.  ``length`` counts code points, like Python's ``len``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.functions import patterns as P

_SPACE = f"[{P.PY_SPACE_CLASS}]"
# Letters and numbers (Python's isalnum) plus Python's whitespace set.
_ALNUM_OR_SPACE = r"[\p{L}\p{N}" + P.PY_SPACE_CLASS + "]"
_TRICKS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in P.UNICODE_TRICK_CHARS) + "]"


def _lit(s: str) -> Column:
    return F.lit(s)


def strip(text: Column) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    return F.regexp_replace(text, _lit(f"^{_SPACE}+|{_SPACE}+$"), _lit(""))


def normalize_whitespace(text: Column) -> Column:
    """B1: every whitespace run becomes one space, then strip."""
    return strip(F.regexp_replace(text, _lit(r"(?U)\s+"), _lit(" ")))


def to_lowercase(text: Column) -> Column:
    """B2."""
    return F.lower(text)


def remove_special_characters(text: Column) -> Column:
    """Keep word characters, whitespace and . , ! ? ; : ' \" -"""
    return F.regexp_replace(text, _lit(r"""(?U)[^\w\s.,!?;:'"-]"""), _lit(""))


def truncate(text: Column, max_length: int) -> Column:
    """First ``max_length`` characters plus ``...`` when longer."""
    return F.when(F.length(text) <= F.lit(max_length), text).otherwise(
        F.concat(F.substring(text, 1, max_length), F.lit("..."))
    )


def approx_tokens(text: Column) -> Column:
    """``max(1, len // 4)``."""
    return F.greatest(F.lit(1), (F.length(text) / F.lit(4)).cast("int")).cast("int")


def has_unicode_tricks(text: Column) -> Column:
    """Any zero-width or direction-override character."""
    return text.rlike(_TRICKS)


def special_char_count(text: Column) -> Column:
    """Characters that are neither alphanumeric nor whitespace.

    Removes runs (``[...]+``), not single characters: same result, one regex
    match per run instead of one per character.
    """
    return F.length(F.regexp_replace(text, _lit(_ALNUM_OR_SPACE + "+"), _lit("")))


def is_blank(text: Column) -> Column:
    """``not text or not text.strip()``."""
    return F.length(F.regexp_replace(text, _lit(_SPACE + "+"), _lit(""))) == 0


# Texts of the exact halves (2 q + 1) / 200: the binary value of a half lies on
# either side of it, so each is formatted here as the rules format it.
_HALVES = [f"{(2 * q + 1) / 200:.2f}" for q in range(100)]


def ratio_2dp(special: Column, n: Column) -> Column:
    """``f"{special/n:.2f}"`` from the integer counts, for ratios of 0 to 1.

    100 * special / n is rounded to the nearest integer; where the remainder is
    exactly one half, the text is looked up by the quotient.
    """
    num = special.cast("long") * F.lit(100)
    den = n.cast("long")
    q = F.floor(num / den).cast("long")
    twice = (num - q * den) * F.lit(2)
    cents = q + F.when(twice > den, F.lit(1)).otherwise(F.lit(0))
    text = F.concat(
        F.floor(cents / F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((cents % F.lit(100)).cast("string"), 2, "0"),
    )
    halves = F.array(*[F.lit(x) for x in _HALVES])
    return F.when(twice == den, F.get(halves, q.cast("int"))).otherwise(text)
