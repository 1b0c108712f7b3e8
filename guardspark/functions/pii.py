"""Personal-data find-all (B9) and match redaction.

Values come from ``regexp_extract_all``, which walks the matches left to right
without overlap, as a find-all does.  Each pattern is gated by a cheap
necessary condition (a literal ``@``, four digits, a digit-dot-digit) so clean
text costs one short scan instead of five regex walks; the gate never changes
a result because every match contains it.

The email pattern alone would be tried again at every word boundary of a long
run of address characters (``a.a.a. ...``) and read to the run's end each time.
``pattern`` therefore has a second branch: at the start of a run of
``LONG_RUN`` or more that no domain follows, it takes the whole run at once.
Such a run holds no ``@``, so ``found`` tells it from an address, and leaving
it unchanged loses nothing: an address that begins inside a run ends behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.functions import patterns as P

PII_TYPES = list(P.PII_PATTERNS)

#: Shorter runs are cheap to retry; a find-all need not list them.
LONG_RUN = 64
_LOCAL = r"[A-Za-z0-9._%+\-]"
_DOMAIN = r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
# a run starts where no address character stands before it, or where the last match ended
_SKIP_RUN = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}{{{LONG_RUN},}}+(?!@{_DOMAIN})"


def pattern(pii_type: str) -> str:
    own = P.java(P.PII_PATTERNS[pii_type])
    return f"{own}|{_SKIP_RUN}" if pii_type == "email" else own


def found(match: Column, pii_type: str) -> Column:
    """Whether a match of ``pattern`` is personal data (not a run passed over)."""
    return match.contains("@") if pii_type == "email" else F.lit(True)


def gate(text: Column, pii_type: str) -> Column:
    """A condition every text with a match of ``pii_type`` satisfies."""
    if pii_type == "email":
        return text.contains("@")
    if pii_type == "ip_address":
        return text.rlike(r"[0-9]\.[0-9]")
    # phone and ssn end in four (Unicode) digits; a card holds 13 or more.
    return text.rlike(r"(?U)\d{4}")


def _all(text: Column, pii_type: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(pii_type)), F.lit(0))


def _wanted(matches: Column, pii_type: str) -> Column:
    return F.filter(matches, lambda m: found(m, pii_type)) if pii_type == "email" else matches


def count(text: Column, pii_type: str) -> Column:
    """Number of non-overlapping matches (BIGINT)."""
    if pii_type == "email":
        n = F.size(_wanted(_all(text, pii_type), pii_type)).cast("long")
    else:
        n = F.regexp_count(text, F.lit(pattern(pii_type))).cast("long")
    return F.when(gate(text, pii_type), n).otherwise(F.lit(0).cast("long"))


def matches(text: Column, pii_type: str) -> Column:
    """All matches, left to right (ARRAY<STRING>)."""
    m = _wanted(_all(text, pii_type), pii_type)
    return F.when(gate(text, pii_type), m).otherwise(F.array().cast("array<string>"))


def raw_matches(text: Column, pii_type: str) -> Column:
    """All matches of ``pattern``, passed-over runs with them: one for each
    gap between the pieces of ``split``."""
    return F.when(gate(text, pii_type), _all(text, pii_type)).otherwise(F.array().cast("array<string>"))


def replace_matches(text: Column, pii_type: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match ``m`` by ``fn(m)``, position exact.

    ``split`` yields the pieces between matches (one more than matches) and
    ``regexp_extract_all`` the matches; ``zip_with`` pads the last match
    with null, which contributes nothing.
    """
    regex = pattern(pii_type)

    def piece(a: Column, m: Column) -> Column:
        put = F.when(m.isNull(), F.lit(""))
        if pii_type == "email":
            put = put.when(~found(m, pii_type), m)
        return F.concat(a, put.otherwise(fn(m)))

    return F.array_join(F.zip_with(F.split(text, regex, -1), _all(text, pii_type), piece), "")


def redact(text: Column, pii_type: str, char: str = "*") -> Column:
    """Each match becomes ``char`` repeated to the match's length."""
    return replace_matches(text, pii_type, lambda m: F.repeat(F.lit(char), F.length(m)))
