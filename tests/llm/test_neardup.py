"""Near-duplicates against all pairs of full sets."""

from __future__ import annotations

import random
from collections import Counter

from helpers import SF, awkward, docs_df, shingles

from guardspark.llm import op3_neardup as nd


def brute(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows):
    got = nd.near_duplicates(docs_df(spark, rows)).collect()
    want = brute([(i, t) for i, t, _ in rows])
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert (g.component_id, g.kept) == (None, True)
        else:
            assert (g.n_shingles, g.component_id) == want[g.doc_id], g
            assert g.kept == (g.doc_id == g.component_id)


def test_awkward_rows(spark):
    check(spark, awkward())


def test_empty_table(spark):
    assert nd.near_duplicates(docs_df(spark, [])).count() == 0
    assert nd.deduplicated(docs_df(spark, [])).count() == 0


def test_group_of_near_copies_around_the_threshold(spark):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((1000 - i, " ".join(words), "a"))
    # copies of copies: chains that no single centre links
    for i in range(40):
        words = rows[r.randrange(len(rows))][1].split()
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words), "b"))
    check(spark, rows)


def test_passage_shared_by_unrelated_documents(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, passage + " " + " ".join(f"x{r.randrange(10**6)}" for _ in range(200)), "a") for i in range(80)]
    check(spark, rows)


def test_shipped_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (5000, 4000)]
    got = nd.components(spark.createDataFrame(edges, "a long, b long")).collect()
    sizes = Counter(r.comp for r in got)
    assert sorted(sizes.values()) == [2, 50, 201]
    assert len({r.node for r in got}) == len(got)


def test_one_row_of_each_group_stays(spark):
    rows = awkward()
    docs = docs_df(spark, rows)
    left = nd.deduplicated(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.select("doc_id").collect())
    want = brute([(i, t) for i, t, _ in rows])
    assert ids == Counter({None: 1} | {i: 1 for i, (_, c) in want.items() if i == c})


def test_texts_that_post_nothing_are_not_shuffled(spark):
    rows = [(i, f"text {i}", "a") for i in range(3000)] + [(7, "again", "a"), (None, "none", "a")]
    docs = docs_df(spark, rows)
    posted = docs.where("doc_id % 100 = 7").select("doc_id").distinct()
    want = sorted((i, t) for i, t, _ in rows if i is not None and i % 100 == 7)
    assert sorted(map(tuple, nd.posted_texts(docs, posted).collect())) == want
    # the bitmap comes before the join that shuffles
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = nd.posted_texts(docs, posted)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert 0 <= plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    # what goes to the join, all rows before: the posted ones and next to no others
    passed = {tuple(r) for r in nd._perhaps_posted(docs.select("doc_id", "text"), posted).collect()}
    assert set(want) <= passed and len(passed) < len(want) + 30
