"""Segments against brute force, and the classifier on labelled texts."""

from __future__ import annotations

import random

import pytest
from helpers import awkward, docs_df
from pyspark.sql import functions as F

from guardspark.llm import op2_toxicity as tx
from guardspark.llm.common import crc_mod


def brute_segments(scores):
    """All maximal scoring segments: the best one, then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            key = (round(total, 9), -(j - i), -i)
            if total > 0 and (best is None or key > best[0]):
                best = (key, i, j, total)
    if best is None:
        return []
    _, i, j, total = best
    left = [x for x in brute_segments(scores[:i])]
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]
    return [*left, (i, j, total), *right]


def test_all_maximal_segments():
    r = random.Random(7)
    for _ in range(300):
        n = r.randint(0, 24)
        hits = [(i, r.choice([0.3, 1.0, 2.5])) for i in range(n) if r.random() < 0.4]
        drift = r.choice([0.05, 0.4, 1.1])
        scores = [-drift] * n
        for i, s in hits:
            scores[i] = s
        got = [(hits[a][0], hits[b][0], pytest.approx(s)) for a, b, s in tx.segments(hits, drift)]
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == [s for *_, s in want]


def corpus(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdklmnrst") for _ in range(r.randint(2, 8)))
    plain = [word() for _ in range(800)]
    insults = ["idiot", "scum", "moron", "clown"]
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(10, 300))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = r.choice(insults) if r.random() < 0.7 else "zorg" + word()
        rows.append((i, " ".join(words), "a"))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def fitted(spark):
    rows, marks = corpus(2500)
    docs = docs_df(spark, rows)
    held = crc_mod(F.col("doc_id"), 5) == 0
    return rows, marks, docs, tx.fit(docs, labels(spark, marks), learns=~held), held


def test_held_out_accuracy(fitted):
    rows, marks, docs, model, held = fitted
    out = tx.scored(docs, model).withColumn("held", held).collect()
    toxic = {i: t for i, _, t in marks}
    unseen = [r for r in out if r.held]
    wrong = sum((r.score >= 0.5) != bool(toxic[r.doc_id]) for r in unseen)
    assert wrong <= 0.02 * len(unseen)
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_outside_the_learning_rows_change_nothing(spark, fitted):
    rows, marks, docs, model, held = fitted
    ids = {r.doc_id for r in docs.where(held).select("doc_id").collect()}
    flipped = [(i, q, 1 - t if i in ids else t) for i, q, t in marks]
    again = tx.fit(docs, labels(spark, flipped), learns=~held)
    assert (again.tokens, again.stems, again.slope, again.bias) == (model.tokens, model.stems, model.slope, model.bias)


def test_unseen_forms_of_a_toxic_stem_are_found(fitted):
    model = fitted[3]
    assert "zorg" in model.stems
    text = "kalm dorin zorgxyzzy " + "mesa " * 20 + "zorgqqq zorgnew"
    assert model.passages(text) and model.score(model.evidence(text)) > model.score(0.0)


def test_passages_are_the_toxic_spans(fitted):
    model = fitted[3]
    clean = "lorem dolor sit amet " * 30
    text = clean + "you IDIOT scum moron " + clean + "idiot clown"
    spans = [text[a:b].lower() for a, b, _, _ in model.passages(text)]
    assert spans == ["idiot scum moron", "idiot clown"]


def test_awkward_rows(spark, fitted):
    model = fitted[3]
    rows = awkward()
    out = tx.scored(docs_df(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score < 0.5 for r in out)
    left = tx.accepted(docs_df(spark, [*rows, (500, "idiot scum moron clown idiot", "a")]), model)
    assert left.columns == docs_df(spark, []).columns and left.count() == len(rows)


def test_odd_labels_and_empty_tables(spark):
    rows, _ = corpus(40)
    odd = labels(spark, [(None, 1, 1), (1, None, None), (10**9, 1, 1), (2, 1, 0), (2, 1, 0)])
    for marks in (odd, labels(spark, [])):
        model = tx.fit(docs_df(spark, rows), marks)
        assert {r.score for r in tx.scored(docs_df(spark, rows), model).collect()} == {model.score(0.0)}
    assert tx.scored(docs_df(spark, []), tx.Model()).count() == 0


@pytest.mark.parametrize("n", [150_000])
def test_the_scan_is_linear(n):
    """Sparse hits whose sums fall, rising runs, and long chains of merges: a scan that walked
    the whole stack took 11 s for 16,000 hits of the first kind."""
    import time

    t0 = time.perf_counter()
    assert len(tx.segments([(10 * i, 2.5) for i in range(n)], 0.5)) == n
    assert len(tx.segments([(2 * i, 0.6) for i in range(n)], 0.5)) == 1
    r = random.Random(1)
    at, hits = 0, []
    for _ in range(n):
        at += r.randint(1, 12)
        hits.append((at, r.choice([0.4, 2.0, 5.0])))
    assert 1 <= len(tx.segments(hits, 0.5)) < n
    assert time.perf_counter() - t0 < 8
    model = tx.Model(tokens={"scum": 3.0}, lam=1.0, k=1e-9)
    text = "scum " + "word " * 9
    found = model.passages(text * 20_000)
    assert len(found) == 20_000 and found[-1][0] == 19_999 * len(text)
