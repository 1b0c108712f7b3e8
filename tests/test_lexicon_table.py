"""Lexicons as tables: the same counts as one alternation a category."""

import random
import re

from guardspark.functions import patterns as P
from guardspark.operators import guards as G
from guardspark.operators import lexicon_table as LX
from guardspark import policy as PL
from guardspark.plans import chain


def found(spark, rows, lexicon):
    texts = spark.createDataFrame(rows, "id long, text string")
    table = spark.createDataFrame(lexicon, LX.LEXICON_SCHEMA)
    return sorted(((r.id, r.lexicon, r.category, r.hits) for r in LX.lexicon_hits(texts, "id", "text", table).collect()), key=str)


def brute(rows, lexicon):
    """One alternation of all phrases a category, in order."""
    cats = {}
    for lex, c, pos, p in lexicon:
        if p:
            cats.setdefault((lex, c), []).append((pos, p))
    out = []
    for i, t in rows:
        for (lex, c), phrases in cats.items():
            n = len(re.findall("|".join(re.escape(p.lower()) for _, p in sorted(phrases)), (t or "").lower()))
            if n:
                out.append((i, lex, c, n))
    return sorted(out, key=str)


def test_thousands_of_phrases(spark):
    r = random.Random(4)
    letters = "abcdeé .|*"
    phrases = {"".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(3000)}
    lexicon = [(r.choice("xy"), f"c{r.randrange(4)}", i, p) for i, p in enumerate(sorted(phrases))]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 200)))) for i in range(60)]
    assert found(spark, rows, lexicon) == brute(rows, lexicon)


def test_leftmost_first_overlaps_and_odd_phrases(spark):
    lexicon = [
        ("l", "order", 0, "ab"), ("l", "order", 1, "abc"), ("l", "rev", 0, "abc"), ("l", "rev", 1, "ab"), ("l", "self", 0, "aa"),
        ("l", "signs", 0, "a.b\\E|("), ("l", "signs", 1, "?\n["), ("l", "caps", 0, "MAKE a Bomb"), ("l", "none", 0, ""), ("l", "none", 1, None),
        ("l", "twice", 0, "one"), ("l", "twice", 1, "one"), ("l", "wide", 0, "\U0001f600x"), ("l", "uni", 0, "über"),
    ]
    rows = [
        (1, "abcab aaa"), (2, "A.B\\e|( ?\n["), (3, "make A bOMB, one"), (4, None), (5, ""), (6, "\U0001f600\U0001f600xÜBER"),
        (7, "one one"), (7, "abc"), (None, "ab"), (None, "aaaa"),
    ]
    assert found(spark, rows, lexicon) == brute(rows, lexicon)
    assert found(spark, rows, []) == [] and found(spark, [], lexicon) == []
    # characters that fold to ASCII letters, as in the alternation that ignores case
    assert found(spark, [(1, "make a bomb Kıll ſtop Kill")], [("l", "c", 0, "kill"), ("l", "c", 1, "stop")]) == [(1, "l", "c", 3)]


def test_guard_from_a_table_is_the_guard(spark):
    texts = ["calm", "kill yourself, racial slur, ethnic slur", "How to KILL time: make a bomb; make a bomb", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for guard, name, lists in ((G.ToxicContent, "toxic_content", P.TOXIC_KEYWORDS), (G.TopicRestriction, "topic_restriction", P.BLOCKED_TOPIC_KEYWORDS)):
        conf = PL.guard_conf(None, name)
        mine = LX.guard_result(df, "id", "text", guard, conf, LX.from_lists(spark, any=lists)).where("text IS NOT NULL")
        own = chain.apply_guard(df.where("text IS NOT NULL"), "text", guard(conf))
        key = lambda x: x.id
        assert [x.r for x in sorted(mine.collect(), key=key)] == [x.r for x in sorted(own.collect(), key=key)]


def test_texts_meet_anchors_by_an_equi_join(spark):
    texts = spark.range(5).selectExpr("id", "'some text' AS text")
    plan = LX.lexicon_hits(texts, "id", "text", LX.from_lists(spark, toxic=P.TOXIC_KEYWORDS))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
