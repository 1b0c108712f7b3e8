"""Operator 13 against a tree hashed whole."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from helpers import awkward, docs_df

from guardspark.llm import op13_merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        c = levels[-1]
        levels.append([sha("".join(c[i : i + 8])) for i in range(0, len(c), 8)])
    return levels


def brute(rows):
    """All columns of the query, each root recomputed from whole runs."""
    low = str.maketrans(M.UPPER, M.LOWER)
    langs: dict = {}
    for x in rows:
        tampered = x[1] is not None and zlib.crc32(("" if x[0] is None else str(x[0])).encode()) % 3 == 0
        langs.setdefault(x[2], []).append((x[0] is not None, x[0], leaf(x, x[1]), leaf(x, x[1].translate(low) if tampered else x[1])))
    names = sorted(langs, key=lambda n: (n is not None, (n or "").encode()))
    trees = [tree([y[2] for y in sorted(langs[n])]) for n in names]
    forest = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, (n, t) in enumerate(zip(names, trees, strict=True)):
        for i, (_, doc_id, own, digest) in enumerate(sorted(langs[n])):
            proof = []
            for levels, at in ((t, i), (forest, k)):
                for nodes in levels[:-1]:
                    a = at // 8 * 8
                    run = nodes[a : a + 8]
                    proof += run[: at - a] + run[at - a + 1 :]
                    run[at - a] = digest
                    digest, at = sha("".join(run)), at // 8
            out.append((doc_id, own, t[-1][0], forest[-1][0], sha("".join(proof)), digest, digest == forest[-1][0]))
    return sorted(out, key=str)


def test_parent_resumes_each_slot():
    r = random.Random(1)
    for n in range(1, 9):
        children = [sha(str(r.random())) for _ in range(n)]
        parent = M.Parent(children)
        assert parent.digest == sha("".join(children))
        for slot in range(n):
            other = sha(str(r.random()))
            assert parent.folded(slot, other) == sha("".join([*children[:slot], other, *children[slot + 1 :]]))
            assert parent.folded(slot, children[slot]) == parent.digest


@pytest.mark.parametrize("rows", [awkward(), awkward()[:1], []], ids=["awkward", "one", "empty"])
def test_awkward_rows(spark, rows):
    docs = docs_df(spark, rows)
    got = [tuple(r) for r in M.tamper_check(docs).collect()]
    assert sorted(got, key=str) == brute([tuple(r)[:5] for r in docs.collect()])


@pytest.mark.parametrize("n, langs", [(700, 1), (1300, 3), (90, 80), (5000, 2)])
def test_trees_of_several_storeys(spark, n, langs):
    r = random.Random(n)
    names = [None, "", "é", "-", "=", *(f"l{i}" for i in range(langs))][:langs] if langs > 4 else ["en", None, "Z"][:langs]
    # one lang holds most rows; ids with gaps, some below 0, some repeated
    rows = [(r.randint(-50, 3 * n), f"Text {i}", names[0] if r.random() < 0.6 else r.choice(names), r.choice(["a", None]), i % 7) for i in range(n)]
    got = [tuple(x) for x in M.tamper_check(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = brute(rows)
    assert len(got) == n and {w[-1] for w in want} == {True, False}
    assert sorted(got, key=str) == want
