"""Benchmark leaks against all item-sized windows of all documents."""

from __future__ import annotations

import random
from collections import Counter

from helpers import SF, awkward, docs_df

from guardspark.llm import op10_decontaminate as dc


def similarity(a: list, b: list, q: int) -> float:
    x = Counter(tuple(a[i : i + q]) for i in range(len(a) - q + 1))
    y = Counter(tuple(b[i : i + q]) for i in range(len(b) - q + 1))
    both = sum((x & y).values())
    return both / max(1, sum((x | y).values()))


def brute(docs, items):
    """{doc key: item ids}: the best window of every size decides."""
    out = {}
    for key, text in docs:
        w = (text or "").lower().split()
        found = []
        for item_id, t in items:
            v = (t or "").lower().split()
            if not v or not w:
                continue
            q, m = min(5, len(v)), min(len(v), len(w))
            best = max((similarity(w[p : p + m], v, q) for p in range(len(w) - m + 1)), default=0)
            if best >= 0.8:
                found.append(item_id)
        out[key] = sorted(found)
    return out


def check(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs_df(spark, rows), bench).collect()
    want = brute([((i, t), t) for i, t, _ in rows], items)
    assert len(got) == len(rows)
    have = sorted((str(g.doc_id), g.item_ids, g.contaminated, g.n_items) for g in got)
    assert have == sorted((str(i), ",".join(map(str, want[i, t])), bool(want[i, t]), len(want[i, t])) for i, t, _ in rows)


def test_reordered_passages(spark):
    r = random.Random(6)
    items = items_of(r, 8, 40, 70)
    rows = []
    for i in range(40):
        v = items[i % 8][1].split()
        cut = len(v) // 2 if i < 16 else r.randrange(8, len(v) - 8)
        v = v[cut:] + v[:cut]
        if i % 4 == 3:
            x, y = sorted(r.sample(range(len(v)), 2))
            v = v[y:] + v[x:y] + v[:x]
        words = [f"w{r.randrange(2000)}" for _ in range(r.randint(0, 120))]
        at = r.randrange(len(words) + 1)
        rows.append((i, " ".join(words[:at] + v + words[at:]), "a"))
    # a text that repeats an item, and one shorter than it
    rows += [(90, " ".join([items[0][1]] * 4), "a"), (91, " ".join(items[1][1].split()[:-2]), "a")]
    check(spark, rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert all(g.contaminated for g in dc.contamination(docs_df(spark, rows[:16:4]), bench).collect())


def items_of(r, n, lo=12, hi=40):
    return [(k, " ".join(f"b{r.randrange(500)}" for _ in range(r.randint(lo, hi)))) for k in range(n)]


def test_edited_passages_inside_documents(spark):
    r = random.Random(4)
    items = items_of(r, 12)
    rows = []
    for i in range(90):
        words = [f"w{r.randrange(2000)}" for _ in range(r.randint(0, 120))]
        if i % 3:
            v = r.choice(items)[1].split()
            for _ in range(r.randint(0, 3)):
                x = r.randrange(len(v))
                edit = r.random()
                v[x : x + 1] = [] if edit < 0.3 else [v[x], "in"] if edit < 0.6 else ["out"]
            at = r.randrange(len(words) + 1)
            words[at:at] = [x.upper() if i % 5 == 0 else x for x in v]
        rows.append((i, " ".join(words), "a"))
    check(spark, rows, items)


def test_awkward_rows_and_items(spark):
    rows = awkward()
    near = rows[6][1].split()
    items = [(1, None), (2, ""), (3, "one"), (4, "one two three four"), (5, " ".join(near[20:60])), (6, " ".join(near[20:60])), (None, " ".join(near[70:100])), (7, "line one here line one here line one here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs_df(spark, rows), bench).collect()
    want = brute([(k, t) for k, (_, t, _) in enumerate(rows)], items[:6] + items[7:])
    assert len(got) == len(rows)
    by_id = {g.doc_id: g for g in got}
    for k, (i, _, _) in enumerate(rows):
        ids = set(filter(None, by_id[i].item_ids.split(",")))
        assert ids == set(map(str, want[k])), (i, ids, want[k])
    assert by_id[7].n_items == 3  # two equal items and the one without id
    left = dc.decontaminated(docs_df(spark, rows), bench)
    assert left.columns == docs_df(spark, rows).columns
    assert left.count() == sum(not g.contaminated for g in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs_df(spark, []), bench).count() == 0
    got = dc.contamination(docs_df(spark, awkward()), none).collect()
    assert len(got) == len(awkward()) and not any(g.contaminated for g in got)


def test_blocks_meet_whenever_the_radius_allows(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), dc.RADIUS):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(pairs, "a long, b long")
    keyed = df.select("a", "b", dc._blocks("a").alias("k")).join(df.select("a", "b", dc._blocks("b").alias("k")), ["a", "b", "k"])
    assert keyed.select("a", "b").distinct().count() == len(set(pairs))


def test_shipped_documents_hold_the_planted_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {g.doc_id: [int(x) for x in g.item_ids.split(",") if x] for g in dc.contamination(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    quick = {}
    marks = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in items}
    for d in docs.collect():
        w = (d.text or "").lower().split()
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near = [(i, t) for i, t in items if marks[i] & have]
        quick[d.doc_id] = brute([(d.doc_id, d.text)], near)[d.doc_id] if near else []
    assert got == quick and any(quick.values())
