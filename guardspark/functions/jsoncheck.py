"""JSON contract (B12): parse check, root type, top-level keys, first failure.

Validity means one complete JSON value with nothing but JSON whitespace around
it, as the rules' parser reads it: duplicate keys and the literals ``NaN``,
``Infinity`` and ``-Infinity`` are accepted; single quotes, comments, unquoted
names, leading zeros and control characters in strings are not.

The text is read once, as the first element of ``[text, mark]``: a second value,
trailing text or a bracket of its own leaves the mark elsewhere than in second
place.  The mark is a digest of the text itself, so no text can be written that brings the mark
along.  Everything is an option of the expression; no session setting is
involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.functions import patterns as P

# expected schema type -> Python type names that satisfy it.  `number`
# accepts booleans too; `integer`, `null` and unknown types check nothing.
TYPE_ACCEPTS: dict[str, list[str]] = {
    "object": ["dict"],
    "array": ["list"],
    "string": ["str"],
    "number": ["int", "float", "bool"],
    "boolean": ["bool"],
}


_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}
_STRINGS = r'"(?:[^"\\]|\\.)*+"'


def is_valid(text: Column) -> Column:
    mark = F.sha2(text.cast("binary"), 256)
    wrapped = F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))
    read = F.from_json(wrapped, "array<string>", _OPTIONS)
    # the reader also takes +Infinity, which is no JSON number in any dialect
    signed = text.contains("+Infinity") & F.regexp_replace(text, F.lit(_STRINGS), F.lit('""')).contains("+Infinity")
    return F.coalesce((F.size(read) == 2) & (F.get(read, F.lit(1)) == mark), F.lit(False)) & ~signed


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("^[ \\t\\n\\r]+"), F.lit(""))


def root_type(text: Column) -> Column:
    """Python type name of the parsed root (meaningful when valid)."""
    s = _stripped(text)
    first = F.substring(s, 1, 1)
    return (
        F.when(first == "{", "dict")
        .when(first == "[", "list")
        .when(first == '"', "str")
        .when(first.isin("t", "f"), "bool")
        .when(first == "n", "NoneType")
        .when(s.rlike("^(-?[0-9]+[.eE]|-?Infinity|NaN)"), "float")
        .otherwise("int")
    )


def object_keys(text: Column) -> Column:
    """Top-level keys of a valid object."""
    return F.map_keys(F.from_json(text, "map<string,string>", _OPTIONS))


def contract_violation(
    valid: Column, root: Column, keys: Column, expected: Column, required: Column
) -> Column:
    """The first failing check as a message, or null."""
    type_ok = F.lit(True)
    for t, accepted in TYPE_ACCEPTS.items():
        type_ok = F.when(expected == t, root.isin(*accepted)).otherwise(type_ok)
    missing = F.filter(
        F.coalesce(required, F.array().cast("array<string>")),
        lambda p: ~F.coalesce(F.array_contains(keys, p), F.lit(False)),
    )
    return (
        F.when(~valid, F.lit(P.MSG_VALID_JSON))
        .when(
            expected.isNotNull() & (expected != "") & ~type_ok,
            F.concat(F.lit("Output type mismatch: expected "), expected, F.lit(", got "), root),
        )
        .when(
            (root == "dict") & (F.size(missing) > 0),
            F.concat(F.lit(P.MSG_VALID_MISSING), F.array_join(missing, ", ")),
        )
    )
