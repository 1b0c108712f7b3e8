"""Quality metrics and risk control against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from helpers import SF, awkward, docs_df
from pyspark.sql import functions as F

from guardspark.llm import op6_quality as ql


def metrics(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(8)}
    symbols = sum(t.count(c) for c in ql.SYMBOLS)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_metrics(spark):
    r = random.Random(6)
    words = ["a", "b", "c#", "d", "é", "漢字", "|", "*%$"]
    rows = awkward() + [(100 + i, "".join(r.choice(words) + r.choice([" ", "\n", "\t", "  "]) for _ in range(r.randint(0, 90))), "a") for i in range(120)]
    rows += [(900, " ".join("abcdefgh" * 3), "a"), (901, "x y " * 6000, "a"), (902, "a b c d e f g h a b c d e f g h", "a")]
    got = ql.judged(docs_df(spark, rows), labels(spark, [])).collect()
    have = sorted((str(g.doc_id), g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) for g in got)
    want = []
    for i, t, _ in rows:
        m = metrics(t)
        bad = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append((str(i), *m, bad, not bad))  # without labels no learnt rule is on
    assert have == sorted(want)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_shipped_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ql.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == metrics(text[g.doc_id])


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (10, 3, 0.2), (500, 4, 0.01), (20000, 150, 0.01), (80000, 0, 0.03), (5, 5, 0.5)])
def test_binomial_tail_is_exact(spark, n, k, p):
    exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    got = spark.range(1).select(ql.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(exact, rel=1e-8, abs=1e-300)


def corpus(spark, n, junk, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, marks = [], []
    for i in range(n):
        bad = r.random() < junk
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(40)), "a"))
        marks.append((i, 0 if bad else 1, 0))
    return docs_df(spark, rows), labels(spark, marks), marks


def test_learnt_rules_reject_junk_and_keep_the_good(spark):
    docs, marks, rows = corpus(spark, 3000, 0.3)
    got = {g.doc_id: g.kept for g in ql.judged(docs, marks).collect()}
    good = [i for i, q, _ in rows if q == 1]
    junk = [i for i, q, _ in rows if q == 0]
    assert sum(not got[i] for i in good) <= ql.RISK * len(good)
    assert not any(got[i] for i in junk)


def tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_each_stratum_goes_as_far_as_its_own_holdout_proves(spark):
    docs, marks, rows = corpus(spark, 4000, 0.3)
    lang = F.when(F.col("doc_id") < 100, "xx").when(F.col("doc_id") < 1800, "*").otherwise("en")
    docs = docs.withColumn("lang", lang)
    m = ql.metrics(docs)
    got = {g.stratum: g for g in ql.last_steps(m, marks).collect()}
    assert set(got) == {"en", "*"}  # a language named like a wildcard is one of its own
    good = {i for i, q, _ in rows if q == 1}
    firsts = {r.doc_id: (r.lang, r.step) for r in ql._first_steps(ql._ratios(m)).where("NOT base_failed").collect()}
    for name, g in got.items():
        steps = [firsts[i][1] for i in good if firsts[i][0] == name]
        k = lambda last, steps=steps: sum(x is not None and x <= last for x in steps)
        assert (g.n, g.k) == (len(steps), k(g.step)) and g.p_value == pytest.approx(tail(g.k, g.n, ql.RISK), rel=1e-6)
        assert g.p_value <= ql.DELTA / 2 and g.k <= ql.RISK * g.n
        if g.step + 1 < len(ql.PATH):  # the next step could not be proven
            assert tail(k(g.step + 1), len(steps), ql.RISK) > ql.DELTA / 2
    judged = {x.doc_id: x for x in ql.judged(docs, marks).collect()}
    for i, (name, step) in firsts.items():
        assert judged[i].kept == (name not in got or step is None or step > got[name].step)
    # the language without proof has no learnt rule, junk or not
    assert all(judged[i].kept and judged[i].failed == "" for i in range(100) if i in firsts)


def test_the_path_goes_from_mild_to_strict():
    assert len(ql.PATH) == len(set(ql.PATH)) == sum(len(g) for _, _, g in ql.RULES.values())
    for rule, (_, sign, _) in ql.RULES.items():
        mine = [c * sign for r, c in ql.PATH if r == rule]
        assert mine == sorted(mine, reverse=True)
    assert [r for r, _ in ql.PATH[: len(ql.RULES)]] == list(ql.RULES)


def test_labels_with_nulls_repeats_and_strangers(spark):
    docs, marks, rows = corpus(spark, 1500, 0.3)
    odd = marks.unionByName(labels(spark, [(None, 1, 0), (10**9, 1, 0), (rows[0][0], 0, 1), (rows[1][0], None, None), (rows[2][0], 7, 0)]))
    assert ql.judged(docs, odd).count() == 1500


def test_empty_table(spark):
    assert ql.judged(docs_df(spark, []), labels(spark, [])).count() == 0
