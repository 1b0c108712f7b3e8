"""Lattice likelihood against all cuts, and base figures against plain counts."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from helpers import SF, awkward, crc_mod, docs_df
from pyspark.sql import functions as F

from guardspark.llm import catalog
from guardspark.llm import op5_lattice as lm
from guardspark.llm.common import crc_mod as crc_col


def all_cuts(lattice, s):
    """Sum over every way to cut s into pieces or spelt characters."""
    if not s:
        return 1.0
    total = math.exp(sum(lattice.byte_pieces[b] for b in s[0].encode())) * all_cuts(lattice, s[1:])
    for n in range(1, len(s) + 1):
        p = lattice.pieces.get(s[:n])
        if p is not None:
            total += math.exp(p) * all_cuts(lattice, s[n:])
    return total


def test_forward_recursion_sums_over_all_cuts():
    r = random.Random(4)
    pieces = ["a", "b", "ab", "ba", "aba", lm.MARK, lm.MARK + "a", lm.MARK + "ab", "é", "c"]
    lattice = lm.Lattice({p: math.log(r.random() / 4) for p in pieces}, [math.log(r.random() / 300) for _ in range(256)], 3)
    for _ in range(60):
        word = "".join(r.choice("abcé漢") for _ in range(r.randint(0, 8)))
        assert lattice.log10_word(word) == pytest.approx(math.log10(all_cuts(lattice, lm.MARK + word)), rel=1e-9)


def test_model_is_a_distribution():
    lattice = lm.make_lattice(lm.default_vocabulary(), 900, 80, 50)
    mass = sum(map(math.exp, lattice.pieces.values())) + sum(map(math.exp, lattice.byte_pieces))
    assert mass == pytest.approx(1.0, abs=1e-9)
    assert 10**lattice.word + 10**lattice.end == pytest.approx(1.0)
    # in the mixture a word is its training share and its spelt form
    spelt = lattice.log10_word("on")
    assert lattice.log10_mixture(spelt, 7) == pytest.approx(math.log10(900 / 980 * 7 / 900 + 80 / 980 * 10**spelt))
    assert lattice.log10_word("x" * 5000) < -1000


def test_score_is_the_marginal_of_all_cuts(spark):
    texts = ["the cat is on a mat", "On A MAT", "on on", "", None, "é ok 漢"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {g.doc_id: g for g in lm.scored(docs_df(spark, rows), F.col("doc_id") >= 4).collect()}
    words = {i: [w.decode() for w in lm.words_of(t)] for i, t, _ in rows}
    train = Counter(w for i in range(4) for w in words[i])
    n, ends = sum(train.values()), 4
    lattice = lm.make_lattice(lm.default_vocabulary())
    end, word = math.log10((ends + 1) / (n + ends + 2)), math.log10((n + 1) / (n + ends + 2))
    cuts = {w: all_cuts(lattice, lm.MARK + w) for mine in words.values() for w in mine}
    for i, mine in words.items():
        assert got[i].score == pytest.approx(end + sum(word + math.log10(cuts[w]) for w in mine), rel=1e-9)
        mixed = [(train[w] + len(train) * cuts[w]) / (n + len(train)) for w in mine]
        assert got[i].mixture_score == pytest.approx(end + sum(word + math.log10(m) for m in mixed), rel=1e-9)


def base(rows):
    c = Counter()
    ends = 0
    for i, t, _ in rows:
        if crc_mod(i, 7) != 2:
            c.update(lm.words_of(t))
            ends += 1
    n = sum(c.values()) + ends
    v = len(c) + (1 if ends else 0)
    out = []
    for i, t, _ in rows:
        words = lm.words_of(t)
        score = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        known = sum(c[w] > 0 for w in words) + (1 if ends else 0)
        out.append((str(i), crc_mod(i, 7) == 2, len(words) + 1, known, n, round(score, 4)))
    return sorted(out)


def check(spark, rows, **options):
    got = lm.scored(docs_df(spark, rows), crc_col(F.col("doc_id"), 7) == 2, **options).collect()
    have = sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got)
    for a, b in zip(have, base(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-3)
    return got


def test_awkward_rows(spark):
    got = check(spark, awkward())
    assert all(math.isfinite(g.score) and g.score < 0 for g in got)


def test_the_split_of_frequent_and_rare_words_does_not_matter(spark):
    docs = docs_df(spark, awkward())
    held = crc_col(F.col("doc_id"), 7) == 2
    a = sorted((str(g.doc_id), round(g.score, 6), round(g.base_score, 6)) for g in lm.scored(docs, held, head=1).collect())
    b = sorted((str(g.doc_id), round(g.score, 6), round(g.base_score, 6)) for g in lm.scored(docs, held, head=10**6).collect())
    assert a == b


def test_shipped_documents_and_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, "a") for r in docs.collect()]
    got = check(spark, rows)
    held = [g for g in got if g.held_out]
    text = {i: t for i, t, _ in rows}
    shuffled = []
    r = random.Random(1)
    for g in held[:20]:
        letters = list(text[g.doc_id])
        r.shuffle(letters)
        shuffled.append((g.doc_id, "".join(letters), "a"))
    noise = lm.scored(docs_df(spark, rows + [(10**6 + 7 * k, t, "a") for k, (_, t, _) in enumerate(shuffled)]), F.col("doc_id") >= 10**6)
    per_token = {True: [], False: []}
    for g in noise.collect():
        per_token[g.held_out].append(g.score / max(1, g.n_tokens))
    assert sum(per_token[True]) / len(per_token[True]) < sum(per_token[False]) / len(per_token[False])


def test_no_training_documents_and_empty_table(spark):
    got = lm.scored(docs_df(spark, awkward()), F.lit(True)).collect()
    assert all(g.train_tokens == 0 and g.n_known == 0 for g in got)
    assert lm.scored(docs_df(spark, []), F.lit(False)).count() == 0


def test_expected_counts_are_those_of_all_cuts():
    r = random.Random(5)
    pieces = ["a", "b", "ab", "ba", "aba", lm.MARK, lm.MARK + "a", "é"]
    lattice = lm.Lattice({p: math.log(r.random() / 4) for p in pieces}, [math.log(r.random() / 300) for _ in range(256)], 3)

    def cuts(s):
        """(probability, pieces) of every way to cut s."""
        if not s:
            yield 1.0, []
            return
        arcs = [(1, [f"<0x{b:02X}>" for b in s[0].encode()], sum(lattice.byte_pieces[b] for b in s[0].encode()))]
        arcs += [(n, [s[:n]], lattice.pieces[s[:n]]) for n in range(1, len(s) + 1) if s[:n] in lattice.pieces]
        for n, names, p in arcs:
            for q, rest in cuts(s[n:]):
                yield math.exp(p) * q, names + rest

    for word in ("", "a", "abab", "aébaa", "cab"):
        every = list(cuts(lm.MARK + word))
        total = sum(p for p, _ in every)
        want, have = Counter(), Counter()
        for p, names in every:
            for name in names:
                want[name] += p / total
        lattice.expect(word, have)
        assert have == pytest.approx(want)
    again = lattice.refitted(have, lattice)
    assert sum(map(math.exp, again.pieces.values())) + sum(map(math.exp, again.byte_pieces)) > 0
    assert again.log10_word("cab") > lattice.log10_word("cab")


def test_the_query_scores_held_out_texts_near_the_base(spark, tmp_path):
    r = random.Random(6)
    parts = ["zu", "schaft", "ver", "keit", "lich", "ung", "ent", "bar", "los", "heit", "tion", "ber"]
    texts = [" ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(120)) for _ in range(150)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    docs_df(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op5_lattice_scores(spark, str(tmp_path)).collect()
    held = [g for g in got if g.held_out]
    assert len(got) == 150 and held and all(math.isfinite(g.score) and g.score < 0 for g in got)
    assert any(g.n_known < g.n_tokens for g in held)
    assert sum(g.score for g in held) > 1.15 * sum(g.base_score for g in held)
    # the vocabulary's own weights stay far below
    own = lm.scored(docs_df(spark, rows), crc_col(F.col("doc_id"), 7) == 2).where("held_out").agg(F.sum("score")).first()[0]
    assert own < 1.15 * sum(g.base_score for g in held)


def test_learning_without_training_documents_changes_nothing(spark):
    docs = docs_df(spark, awkward())
    a, b = (sorted((str(g.doc_id), g.score) for g in lm.scored(docs, F.lit(True), rounds=n).collect()) for n in (0, 2))
    assert a == b


def test_all_distinct_training_words_teach_the_weights(spark):
    # pieces of one character, so that a word's cuts have each of its characters once
    pieces = dict.fromkeys([lm.MARK, "w", "z", *"0123456789abcdef"], math.log(1 / 19))
    n = 120_000
    seldom = F.when(F.col("id") % 6000 == 17, "z").otherwise("")
    counts = spark.range(n).select(F.concat(F.lit("w"), F.lower(F.hex("id")), seldom).alias("word"), F.lit(1).alias("c"), F.lit(1).alias("f"))
    counts = counts.union(spark.range(50).select(F.concat(F.lit("zz"), "id"), F.lit(0), F.lit(1)))  # not of training
    letters = Counter("".join(f"{lm.MARK}w{i:x}{'z' * (i % 6000 == 17)}" for i in range(n)))
    got = lm.fitted(counts, lm.Lattice(pieces, longest=1, occurrences=n, distinct=n, ends=1), 1)
    total = sum(letters.values()) + lm.PRIOR
    assert {c: math.exp(p) * total for c, p in got.pieces.items()} == pytest.approx({c: letters[c] + lm.PRIOR / 19 for c in pieces}, rel=1e-6)
    assert letters["z"] == 20


def test_many_words_at_once_are_as_one_by_one(monkeypatch):
    r = random.Random(7)
    pieces = ["a", "b", "ab", "ba", "aba", lm.MARK, lm.MARK + "a", lm.MARK + "ab", "é", "bbbb", "漢a"]
    lattice = lm.Lattice({p: math.log(r.random() / 4) for p in pieces}, [math.log(r.random() / 300) for _ in range(256)], 4)
    words = ["".join(r.choice("abcé漢😀") for _ in range(r.randint(0, 14))) for _ in range(300)] + ["", "a", "ab" * 2000, "😀"]
    monkeypatch.setattr(lm, "LONG", 12)
    for together in (1, 50, 10**6):
        monkeypatch.setattr(lm, "TOGETHER", together)
        assert lattice.log10_words(words) == pytest.approx([lattice.log10_word(w) for w in words], rel=1e-12)
        want, have = Counter(), Counter()
        for w in words:
            lattice.expect(w, want)
        lattice.expect_all(words, have)
        assert have == pytest.approx(want, rel=1e-9)
    assert lattice.log10_words([]) == []
    # a vocabulary of bytes alone
    spelt = lm.Lattice()
    assert spelt.log10_words(["ab"]) == pytest.approx([spelt.log10_word("ab")])
