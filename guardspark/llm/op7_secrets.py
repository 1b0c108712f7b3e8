r"""Operator 7 (native): secret scan with multipart credential linking.

Base kinds, found by pattern alone, leftmost and not overlapping per kind:
``assign`` (a named value of 6 or more characters), ``access`` (``AKIA`` and
20 or more characters in all), ``hex`` (24 or more).  They are always reported.

Weak kinds are too common to report alone: ``id`` (a user, login, account,
client or key id that is given a value, or a mail address), ``blob`` (16 or
more characters of a key alphabet with a digit among them) and ``endpoint`` (a
URL or an IPv4 address).  A weak candidate is reported only when a complementary
part lies within its scope, ``SCOPE`` characters before or after it:

* ``id`` needs a secret (assign, hex or blob),
* ``blob`` needs an identifier (access or id) or an endpoint,
* ``endpoint`` needs a secret.

This is an interval join: parts and candidates meet on (document, cell of SCOPE
characters), a part in every cell its scope covers, a candidate in every cell
it touches, and the intervals confirm.  It is a semi-join, so no pairs come out;
a candidate found in several of its cells is reported once.

Positions: the pieces between the matches (``split``) and the matches
(``regexp_extract_all``) alternate, so running sums of their lengths give the
places, in code points.

Scale: one pass over the texts writes only lengths (one row per document); all
later steps carry positions, keyed by that row, so a document with very many
parts is the largest group and its cells split it for the join.

Defined results: null and empty texts have no spans; the hash of no spans is
the hash of the empty string; very long texts are scanned whole; a mail address is taken from at most 64
characters before its ``@`` on, so a longer local part starts late (it is still found); spans with one start stand in the order of
``KINDS``; repeated rows are each scanned; a null doc_id is
allowed; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.llm.common import staged

#: Kinds in the order that breaks ties of spans with one start.
KINDS = ("assign", "access", "hex", "id", "blob", "endpoint")
BASE = KINDS[:3]
SCOPE = 200

_NAMES = r"(password|passwd|secret|token|api_?key)"
ASSIGN = rf"(?i){_NAMES}" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# a run of 24 or more is the leftmost run of hex digits, cut where that is cut
HEX = r"[0-9a-f]{24,}"
_ID_NAMES = r"(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id|key_?id)"
ID = (
    rf"(?i)\b{_ID_NAMES}" + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
    r"|[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,253}"
)
BLOB = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"""[a-z]{2,12}://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9])"""

#: kind -> (pattern, group whose length is kept, necessary condition)
_RULES = {
    "assign": (ASSIGN, 2, lambda t: t.rlike(f"(?i){_NAMES}")),
    "access": (ACCESS, 0, lambda t: t.contains("AKIA")),
    "hex": (HEX, 0, lambda t: t.rlike(HEX)),
    "id": (ID, 0, lambda t: t.contains("@") | t.rlike(rf"(?i){_ID_NAMES}")),
    "blob": (BLOB, 0, lambda t: t.rlike(r"[A-Za-z0-9+/_-]{16}") & t.rlike("[0-9]")),
    "endpoint": (ENDPOINT, 0, lambda t: t.contains("://") | t.rlike(r"[0-9]\.[0-9]")),
}
_LEAST = {"assign": 6, "access": 20, "hex": 24, "id": 0, "blob": 0, "endpoint": 0}

_PARTS = "array<struct<gap:int,len:int,size:int>>"


def _lengths(text: Column, kind: str) -> Column:
    """For each match: the length of the piece before it, of the match and of
    the group that must be long enough."""
    pattern, group, needs = _RULES[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    sizes = whole if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), sizes.alias("size"))
    return F.when(needs(text), F.filter(zipped.cast(_PARTS), lambda p: p["len"].isNotNull())).otherwise(
        F.array().cast(_PARTS)
    )


def scanned(docs: DataFrame) -> DataFrame:
    """Staged rows (uid, doc_id, one array of lengths for each kind)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), "doc_id", *[_lengths(t, k).alias(k) for k in KINDS]
        ),
        "secret-lengths",
    )


def parts(scan: DataFrame) -> DataFrame:
    """Rows (uid, k, from, to): all matches that are long enough, k the kind's
    place in KINDS."""
    out = None
    for k, kind in enumerate(KINDS):
        rows = scan.where(F.size(kind) > 0).select("uid", F.lit(k).alias("k"), F.posexplode(kind).alias("i", "p"))
        out = rows if out is None else out.unionByName(rows)
    upto = Window.partitionBy("uid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to = F.sum(F.col("p.gap").cast("long") + F.col("p.len")).over(upto)
    least = F.element_at(F.array(*[F.lit(_LEAST[k]) for k in KINDS]), F.col("k") + 1)
    return (
        out.withColumn("to", to)
        .where(F.col("p.size") >= least)
        .select("uid", "k", (F.col("to") - F.col("p.len")).alias("from"), "to")
    )


def linked(found: DataFrame) -> DataFrame:
    """Weak parts with a complementary part within their scope."""
    secret = F.col("k").isin(0, 2, 4)
    identifier = F.col("k").isin(1, 3)
    role = F.when(secret, "secret").when(identifier, "id").otherwise("endpoint")
    reach = found.select(
        F.col("uid").alias("u"),
        F.greatest(F.col("from") - SCOPE, F.lit(0)).alias("lo"),
        (F.col("to") + SCOPE).alias("hi"),
        role.alias("role"),
    ).withColumn("c", F.explode(F.sequence(F.floor(F.col("lo") / SCOPE), F.floor(F.col("hi") / SCOPE))))
    weak = found.where(F.col("k") >= len(BASE)).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("from") / SCOPE), F.floor(F.col("to") / SCOPE)))
    )
    complementary = F.when(F.col("k") == 4, F.col("role") != "secret").otherwise(F.col("role") == "secret")
    return weak.join(
        reach,
        (F.col("uid") == F.col("u"))
        & (F.col("cell") == F.col("c"))
        & (F.col("from") <= F.col("hi"))
        & (F.col("to") >= F.col("lo"))
        & complementary,
        "left_semi",
    ).select("uid", "k", "from", "to").distinct()


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan, reported): reported rows (uid, k, from, to) of the rows of scan."""
    scan = scanned(docs)
    found = staged(parts(scan), "secret-parts")
    base = found.where(F.col("k") < len(BASE))
    return scan, base.unionByName(linked(found))


def report(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_linked (weak candidates reported)."""
    scan, reported = spans(docs)
    per = reported.groupBy("uid").agg(
        *[F.count_if(F.col("k") == i).alias(f"n_{KINDS[i]}") for i in range(len(BASE))],
        F.count_if(F.col("k") >= len(BASE)).alias("n_linked"),
        # the spans of one document
        F.array_sort(F.collect_list(F.struct("from", "k", "to"))).alias("s"),
    )
    kind = F.array(*[F.lit(k) for k in KINDS])
    show = lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["from"], x["to"])
    none = F.array().cast("array<struct<from:bigint,k:int,to:bigint>>")
    rows = scan.select("uid", "doc_id").join(per, "uid", "left").withColumn("s", F.coalesce("s", none))
    base = F.array_join(F.transform(F.filter("s", lambda x: x["k"] < len(BASE)), show), ",")
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("s", show), ",").alias("spans"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
