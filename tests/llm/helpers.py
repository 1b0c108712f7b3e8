"""Plain-Python models and awkward rows shared by the operators' tests."""

from __future__ import annotations

import random
import zlib

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, h string, node long, __row int, token string"


def docs_df(spark, rows):
    """Documents from (doc_id, text, source) with extra columns whose names
    the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", "y", 5, 1, "z") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed: int = 1) -> list[tuple]:
    """Null, blank, short, long, repeated and near-equal rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    half = base[:60] + [r.choice(words) for _ in range(60)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (4, "one", "a"),
        (5, "One", "b"),
        (6, "one two three four", "b"),
        (7, " ".join(base), "a"),
        (8, " ".join(near), "a"),
        (9, " ".join(base).upper(), None),
        (10, " ".join(half), "c"),
        (11, long, "c"),
        (12, long, "c"),
        (13, long + " tail", "b"),
        (None, " ".join(base), "a"),
        (14, " ".join(base), "a"),
        (14, " ".join(base), "a"),  # a repeated row
        (15, "über straße naïve café 漢字 " * 12, "a"),
        (16, "line one here\n" * 30, "b"),
    ]
    return rows


def crc_mod(doc_id, m: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def shingles(text, k: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
