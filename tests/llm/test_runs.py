"""Operator 11 against all periods of all stretches."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from helpers import SF, awkward, docs_df

from guardspark.llm import catalog, op11_runs
from guardspark.llm.common import table


def brute_lyndon(s):
    """Longest word at each place that is smaller than all its proper suffixes."""
    n, out = len(s), []
    for i in range(n):
        ends = [j for j in range(i + 1, n + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))]
        out.append(max(ends) - i)
    return out


def brute_runs(w):
    n, found = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q):
                smaller = any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q))
                if not smaller:
                    found.add((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The query's row, from its contract alone."""
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    keep = [True] * n
    for s, size, q in runs:
        keep[s + q : s + size] = [False] * (size - q)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest(),
    )


def test_lyndon_arrays_of_both_orders():
    r = random.Random(5)
    for _ in range(600):
        s = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 16))]
        ranks = {v: i for i, v in enumerate(sorted(set(s)))}
        s = [ranks[x] for x in s]
        assert op11_runs.lyndon_array(s) == brute_lyndon(s)
        other = [max(s) - x for x in s]
        assert op11_runs.lyndon_array(other) == brute_lyndon(other)


def test_runs_of_random_and_periodic_words():
    r = random.Random(6)
    for _ in range(1500):
        n, k = r.randint(0, 60), r.randint(1, 4)
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.7:
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert op11_runs.text_runs(w) == brute_runs(w)


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b"] * 30_000, [str(i % 7001) for i in range(60_000)]], ids=["one", "two", "long"])
def test_a_long_text_is_one_run(words):
    p = len(set(words))
    assert op11_runs.text_runs(words) == [(0, 60_000, p)]
    assert len(op11_runs.collapsed([w.encode() for w in words], [(0, 60_000, p)]).split()) == p


def test_query_on_the_table(spark):
    got = catalog.QUERIES["op11_periodic_runs"](spark, SF).collect()
    want = {r.doc_id: expected(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()}
    assert len(got) == len(want) and any(g.n_runs for g in got)
    for g in got:
        assert tuple(g) == want[g.doc_id]


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_awkward_rows(spark, rows):
    rows = [x for x in rows if len(x[1] or "") < 50_000] + [(90, "x " * 9000, None), (91, "a\tb\x0ba b a b a b", "s")] * bool(rows)
    got = op11_runs.digest(op11_runs.periodic_runs(op11_runs.with_periodic_tails(docs_df(spark, rows)))).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(g) for g in got), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
