"""Reversible tokenization.

D1 ``tokenize`` replaces every match, type by type in order, with
``<PII_{TYPE}_{8 hex}>``.  The hex digits are taken from the keyed digest
(HMAC-SHA256) of request id and value: the same value in one request always
gets the same token (also on a rerun after an executor loss), and no state is
shared between rows, so tokenizing is a narrow map.  Replacement is position
exact (each match where it was found).

Token width: 8 hex digits tell values of one request apart.  Where two values
of one type in one request share the first 8 digits, all values of that type in
that request take the next 8 digits that differ.  Hex digits never form a phone,
SSN or card number, so later types cannot match inside a token.

The pairs ``(token, pii_type, value)`` of a row stay in the row as an array:
a job that tokenizes and restores in one plan (``plans.verdict``) needs no
join.  D2 ``vault_table`` explodes them into the sensitive vault table; D3
``detokenize_join`` restores texts of a later job by joining it back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.functions import patterns as P
from guardspark.functions import pii
from guardspark.operators import result as R
from guardspark.plancache import cached, fingerprint

TOKEN_REGEX = r"<PII_[A-Z_]+_[0-9a-f]{8}>"
PAIR_TYPE = "array<struct<token:string,pii_type:string,value:string>>"


def keyed_digest(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as 64 hex digits: the two nested digests of its definition."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\x00")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def _marked(raw: Column, pii_type: str, request_id: Column, secret: str) -> Column:
    """Each raw match as (value, digest): the digest is null for a run the
    pattern passed over."""
    rid = F.coalesce(request_id.cast("string"), F.lit(""))

    def mark(m: Column) -> Column:
        digest = keyed_digest(secret, F.concat(rid, F.lit("\u0001"), m))
        return F.struct(m.alias("value"), F.when(pii.found(m, pii_type), digest).alias("digest"))

    return F.transform(raw, mark)


def _part(digest: Column, at: Column) -> Column:
    return F.substring(digest, at * P.TOKEN_HEX + 1, F.lit(P.TOKEN_HEX))


def _apart(digests: Column, at: Column) -> Column:
    return F.size(F.array_distinct(F.transform(digests, lambda d: _part(d, at)))) == F.size(digests)


def _offset(marks: Column) -> Column:
    """The first part of the digests that tells all of them apart (0 unless
    two values clash)."""
    digests = F.array_distinct(F.filter(F.transform(marks, lambda m: m["digest"]), lambda d: d.isNotNull()))
    later = F.filter(F.sequence(F.lit(1), F.lit(64 // P.TOKEN_HEX - 1)), lambda s: _apart(digests, s))
    return (
        F.when(F.size(marks) < 2, F.lit(0))
        .when(_apart(digests, F.lit(0)), F.lit(0))
        .otherwise(F.coalesce(F.get(later, F.lit(0)), F.lit(0)))
    )


def _pairs(marks: Column, at: Column, pii_type: str) -> Column:
    """A (token, pii_type, value) pair for each mark."""

    def pair(m: Column, offset: Column) -> Column:
        token = F.concat(F.lit(P.TOKEN_PREFIX + pii_type.upper() + "_"), _part(m["digest"], offset), F.lit(P.TOKEN_SUFFIX))
        return F.struct(token.alias("token"), F.lit(pii_type).alias("pii_type"), m["value"].alias("value"))

    # the offset is bound once a row: the optimizer puts its whole expression where it
    # is read, and inside the lambda over the marks that would be once a match
    return _bound(at, lambda offset: F.transform(marks, lambda m: pair(m, offset)))


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once a row, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _distinct_pairs(pairs: Column, pii_type: str) -> Column:
    """The distinct pairs of one type.  Strings are told apart by hashing; structs would be
    compared with each other."""
    texts = F.array_distinct(F.filter(F.transform(pairs, lambda p: F.concat(p["token"], p["value"])), lambda x: x.isNotNull()))
    width = len(P.TOKEN_PREFIX + pii_type + "_") + P.TOKEN_HEX + len(P.TOKEN_SUFFIX)

    def pair(x: Column) -> Column:
        return F.struct(
            F.substring(x, 1, width).alias("token"),
            F.lit(pii_type).alias("pii_type"),
            F.substring(x, F.lit(width + 1), F.length(x)).alias("value"),
        )

    return F.transform(texts, pair)


def tokenize_steps(
    text: Column, request_id: Column, types: list[str], secret: str
) -> list[tuple[str, Column]]:
    """(column name, expression) steps for sequential selects, for each type:
    its matches with digests, its pairs and the text it leaves.  The pattern
    is walked once for the matches and once for the pieces between them; each
    match is hashed once."""
    steps: list[tuple[str, Column]] = []
    current = text
    for k, t in enumerate(types):
        marks, at, pairs = F.col(f"__vm{k}"), F.col(f"__vo{k}"), F.col(f"__vq{k}")
        steps.append((f"__vm{k}", _marked(pii.raw_matches(current, t), t, request_id, secret)))
        steps.append((f"__vo{k}", _offset(marks)))
        steps.append((f"__vq{k}", _pairs(marks, at, t)))
        # a null token stands for a run passed over, a null pair for the end of the text
        put = lambda a, p: F.concat(a, F.when(p.isNull(), F.lit("")).otherwise(F.coalesce(p["token"], p["value"])))
        joined = F.array_join(F.zip_with(F.split(current, pii.pattern(t), -1), pairs, put), "")
        steps.append((f"__vt{k}", F.when(F.size(pairs) > 0, joined).otherwise(current)))
        current = F.col(f"__vt{k}")
    return steps


def tokenize(
    df: DataFrame,
    text: str,
    request_id: str,
    types: list[str],
    secret: str,
    out_text: str = "tokenized_text",
    out_pairs: str = "vault_pairs",
) -> DataFrame:
    """Add the tokenized text and the row's distinct vault pairs."""
    types = [t for t in types if t in P.PII_PATTERNS]
    key = ("vault", text, request_id, tuple(types), fingerprint(secret), out_text, out_pairs)
    steps, hidden = cached(key, lambda: _tokenize_plan(text, request_id, types, secret, out_text, out_pairs))
    for cols in steps:
        df = df.select("*", *cols)
    return df.drop(*hidden)


def _tokenize_plan(text, request_id, types, secret, out_text, out_pairs):
    """Select steps for ``tokenize``, built once per settings."""
    steps: list[list[Column]] = []
    hidden = []
    for name, expr in tokenize_steps(F.col(text), F.col(request_id), types, secret):
        steps.append([expr.alias(name)])
        hidden.append(name)
    if types:
        final = F.col(f"__vt{len(types) - 1}")
        # tokens name their type, so distinct within a type is distinct
        pairs = F.concat(*[_distinct_pairs(F.col(f"__vq{k}"), t) for k, t in enumerate(types)])
    else:
        final = F.col(text)
        pairs = F.array().cast(PAIR_TYPE)
    steps.append([R.sealed(**{out_text: final, out_pairs: pairs})])
    return steps, hidden


def has_pii(pairs: Column) -> Column:
    return F.size(pairs) > 0


def detokenize(text: Column, pairs: Column) -> Column:
    """D3, in-row: replace every token of ``pairs`` by its value.

    The text is cut at its tokens once, and each is looked up among the row's tokens;
    a token of no pair stays as it is.
    """
    known = F.struct(F.transform(pairs, lambda p: p["token"]).alias("tokens"), F.transform(pairs, lambda p: p["value"]).alias("values"))

    def restored(k: Column) -> Column:
        def put(piece: Column, token: Column) -> Column:
            at = F.array_position(k["tokens"], token).cast("int")
            value = F.when(at > 0, F.get(k["values"], at - 1)).otherwise(token)
            return F.concat(piece, F.when(token.isNull(), F.lit("")).otherwise(value))

        tokens = F.regexp_extract_all(text, F.lit(TOKEN_REGEX), F.lit(0))
        return F.array_join(F.zip_with(F.split(text, TOKEN_REGEX, -1), tokens, put), "")

    return F.when(F.size(pairs) > 0, _bound(known, restored)).otherwise(text)


def vault_table(tokenized: DataFrame, request_id: str = "request_id", pairs: str = "vault_pairs"):
    """``(request_id, token, pii_type, value)``, one row per token of a row.

    Pairs are distinct within a row, so no shuffle is needed.  A request id that
    occurs in several rows has the tokens of each; ``store`` keeps one of equal ones.
    """
    # taken through transform: over a bare column the optimizer would infer a
    # filter and copy the whole tokenizing expression into it
    rows = F.transform(pairs, lambda p: F.struct(p["token"].alias("token"), p["pii_type"].alias("pii_type"), p["value"].alias("value")))
    return tokenized.select(F.col(request_id).alias("request_id"), F.inline(rows))


def detokenize_join(
    texts: DataFrame, vault: DataFrame, request_id: str = "request_id", text: str = "text"
) -> DataFrame:
    """D3 across jobs: restore tokens in ``texts`` from a stored vault table.

    Only requests whose text holds a token, and only vault rows of such tokens,
    take part: the vault is joined on (request, token) to the tokens found in
    the texts, then grouped per request, so a group holds one entry per distinct
    token of one text, however often a request id occurs in the vault.
    """
    found = texts.select(
        F.col(request_id).alias("request_id"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TOKEN_REGEX), F.lit(0)))).alias("token"),
    ).distinct()
    per_request = (
        vault.select("request_id", "token", "value")
        .dropDuplicates(["request_id", "token"])
        .join(found, ["request_id", "token"])
        .groupBy("request_id")
        .agg(F.collect_list(F.struct("token", "value")).alias("__pairs"))
    )
    joined = texts.join(
        per_request, texts[request_id] == per_request["request_id"], "left"
    ).drop(per_request["request_id"])
    pairs = F.coalesce(F.col("__pairs"), F.array().cast("array<struct<token:string,value:string>>"))
    restored = F.when(
        F.col(text).contains(P.TOKEN_PREFIX), detokenize(F.col(text), pairs)
    ).otherwise(F.col(text))
    return joined.withColumn(text, restored).drop("__pairs")


def token_type(token: Column) -> Column:
    """The lowercased type name inside a token."""
    return F.lower(F.regexp_extract(token, r"^<PII_(.*)_[^_]*>$", 1))


def store(
    df: DataFrame,
    text: str,
    request_id: str,
    types: list[str],
    secret: str,
    path: str,
) -> tuple[DataFrame, DataFrame]:
    """Tokenize once and keep two tables under ``path`` (a shared folder).

    ``{path}/tokenized`` holds ``request_id, tokenized_text`` and the pairs;
    the returned texts leave the pairs out.  ``{path}/vault`` holds the sensitive
    ``(request_id, token, pii_type, value)`` rows, read back from the pairs column
    of the first table alone, so the regex work runs once and nothing is kept
    on executors.  Store both with restricted access.
    """
    spark = df.sparkSession
    tokenize(df, text, request_id, types, secret).select(
        F.col(request_id).alias("request_id"), "tokenized_text", "vault_pairs"
    ).write.parquet(f"{path}/tokenized")
    stored = spark.read.parquet(f"{path}/tokenized")
    vault_table(stored).dropDuplicates(["request_id", "token", "value"]).write.parquet(f"{path}/vault")
    return stored.select("request_id", "tokenized_text"), spark.read.parquet(f"{path}/vault")


def restore(texts: DataFrame, vault_path: str, request_id: str = "request_id", text: str = "text"):
    """D3 as a later job: restore tokens in ``texts`` from a stored vault."""
    vault = texts.sparkSession.read.parquet(vault_path)
    return detokenize_join(texts, vault, request_id, text)
