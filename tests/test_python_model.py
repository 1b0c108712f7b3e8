"""Spark against a per-text Python model (``regex`` module, Unicode rules)
over the shipped documents: find-all counts (B9), special-character counts
(B8) and redaction (B5, safe order)."""

import pyarrow.parquet as pq
import regex
from conftest import SF_ORACLE

from guardspark.functions import patterns as P
from guardspark.functions import pii
from guardspark.functions import text as TX
from pyspark.sql import functions as F

COMPILED = {k: regex.compile(v) for k, v in P.PII_PATTERNS.items()}


def model(t):
    counts = {k: len(p.findall(t)) for k, p in COMPILED.items()}
    special = sum(1 for c in t if not c.isalnum() and not c.isspace())
    red = t
    for k in P.SAFE_REDACT_ORDER:
        red = COMPILED[k].sub(lambda m: "*" * len(m.group()), red)
    return counts, special, red


def test_documents_match_python_model(spark):
    tbl = pq.read_table(f"{SF_ORACLE}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = {r["doc_id"]: model(r["text"]) for r in tbl}
    df = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    t = F.col("text")
    red = t
    for k in P.SAFE_REDACT_ORDER:
        red = F.when(pii.count(red, k) > 0, pii.redact(red, k)).otherwise(red)
    rows = df.select(
        "doc_id",
        *[pii.count(t, k).alias(k) for k in P.PII_PATTERNS],
        TX.special_char_count(t).alias("special"),
        red.alias("red"),
    ).collect()
    assert len(rows) == len(expected)
    for r in rows:
        counts, special, redacted = expected[r.doc_id]
        assert {k: r[k] for k in P.PII_PATTERNS} == counts, r.doc_id
        assert r.special == special, r.doc_id
        assert r.red == redacted, r.doc_id


def test_density_text_matches_python_format(spark):
    rows = pq.read_table(f"{SF_ORACLE}/events.parquet", columns=["event_id", "props"]).to_pylist()
    texts = [r["props"] for r in rows] + ["abc!!!!!", "a!", "ab!!!!!!!!", "x" * 37 + "!" * 63]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    t = F.col("t")
    got = df.select(
        "id", TX.ratio_2dp(TX.special_char_count(t), F.length(t)).alias("txt")
    ).orderBy("id").collect()
    for r in got:
        s = texts[r.id]
        special = sum(1 for c in s if not c.isalnum() and not c.isspace())
        assert r.txt == f"{special / len(s):.2f}", s


def test_every_density_tie_matches_python_format(spark):
    rows = [(s, n) for n in (8, 40, 200, 600) for s in range(n + 1)]
    df = spark.createDataFrame(rows, "s long, n long")
    for r in df.select("s", "n", TX.ratio_2dp(F.col("s"), F.col("n")).alias("txt")).collect():
        assert r.txt == f"{r.s / r.n:.2f}", (r.s, r.n)


def test_email_walk_on_random_texts(spark):
    import random

    r = random.Random(5)
    parts = ["a", "b.c", "@", "x", ".", " ", "%", "-", "_", "é", "com", "a@b.co", "@@", "a.a.a.", "1", "+", "org", "\n", "a" * 70]
    parts += [".-%" * 30, "@x.", "ñ@", "Z" * 64 + "@", "a@b.com.a.a"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    email = COMPILED["email"]
    for g in df.select("i", pii.count(t, "email").alias("n"), pii.matches(t, "email").alias("m"), pii.redact(t, "email").alias("r")).collect():
        found = email.findall(texts[g.i])
        assert (g.n, g.m) == (len(found), found), texts[g.i]
        assert g.r == email.sub(lambda m: "*" * len(m[0]), texts[g.i])


def test_email_walk_is_linear_in_runs_of_address_characters(spark):
    import time

    hostile = ["a." * 25000 + "@", "x@" + "a." * 25000, "a@b.com" + ".a" * 25000, "a@" * 20000, "@" + "a-" * 25000]
    df = spark.createDataFrame([(t,) for t in hostile], "t string").coalesce(1)
    df.select(pii.count(F.col("t"), "email")).collect()
    t0 = time.time()
    df.select(pii.count(F.col("t"), "email"), F.length(pii.redact(F.col("t"), "email"))).collect()
    assert time.time() - t0 < 10


EDGE_TEXTS = [
    "Call ٥٥٥-١٢٣-٤٥٦٧ now",  # Arabic-Indic digits
    "studies\u00a0show it",  # no-break space
    "As (Müller et al., 2023) said",
    "éjohn@mail.com and john@mail.com",
    "under_score@x.io, x@y.z",
    "card ４１１１１１１１１１１１１１１１ fullwidth",
    "ip 10.0.0.1x and 300.1.1.1 and 1.2.3.4",
    "step ٣ then MIX",
    "Journal of Économie, published in 1999",
    "ssn 123 45 6789 and 123-45-6789",
    "",
]


def test_unicode_edges_match_python_model(spark):
    from guardspark.functions import lexicon as L

    markers = {
        "stat": (L.STATISTIC, P.STATISTIC),
        "asrt": (L.ASSERTION, P.ASSERTION),
        "cite": (L.CITATION, P.CITATION),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXTS)], "id long, t string")
    t = F.col("t")
    rows = df.select(
        "id",
        *[pii.count(t, k).alias(k) for k in P.PII_PATTERNS],
        *[L.marker_count(t, j).alias(n) for n, (j, _) in markers.items()],
        L.marker_found(t, L.HARMFUL_INSTRUCTION).alias("harm"),
    ).orderBy("id").collect()
    harm = regex.compile(P.HARMFUL_INSTRUCTION, regex.IGNORECASE)
    for r in rows:
        s = EDGE_TEXTS[r.id]
        for k, p in COMPILED.items():
            assert r[k] == len(p.findall(s)), (k, s)
        for n, (_, src) in markers.items():
            assert r[n] == len(regex.findall(src, s, regex.IGNORECASE)), (n, s)
        assert r.harm == bool(harm.search(s)), s
