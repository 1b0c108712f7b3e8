"""The mix against a plain model of targets and schedule."""

from __future__ import annotations

from collections import defaultdict

import pytest
from helpers import SF, awkward, docs_df

from guardspark.llm import op9_mix as mx


def water_fill(sizes):
    """Targets by repeated resharing, as the definition says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    free, left = set(order), float(sum(sizes.values()))
    while free and left > 0:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not full:
            for s in free:
                target[s] = weight[s] * unit
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
        free -= full
        left -= sum(target[s] for s in full)
    return target


def totals(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    return sizes


def check(spark, rows):
    got = mx.taken_words(docs_df(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = totals(rows)
    want = water_fill(sizes)
    taken = defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source]
        assert g.target == pytest.approx(want[g.source], rel=1e-9, abs=1e-9)
        assert 0 <= g.taken <= 3 * g.size
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    return got


def test_awkward_rows(spark):
    check(spark, awkward())


def test_scarce_sources_are_capped_and_the_rest_reshared(spark):
    rows = [(i, "w " * 200, f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, "w " * 5, "t") for i in range(4)] + [(2000, "w", "u"), (2001, None, "v"), (2002, "a b", None)]
    got = check(spark, rows)
    assert {g.taken for g in got if g.source == "t"} == {15}
    assert {g.taken for g in got if g.source == "v"} == {0}


def test_reruns_agree_and_partitioning_does_not_matter(spark):
    docs = docs_df(spark, awkward())
    rows = lambda df: sorted((str(r.doc_id), r.size, r.taken) for r in mx.taken_words(df).collect())
    assert rows(docs.repartition(7)) == rows(docs.coalesce(1))


def test_pieces_lie_inside_documents_and_do_not_overlap(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, _, pieces = mx.mix(docs, slots=500)
    size = {r.uid: r["size"] for r in sizes.collect()}
    seen = defaultdict(list)
    rows = pieces.collect()
    for r in rows:
        assert 0 <= r["first"] and r["first"] + r["words"] <= size[r.uid] and r["words"] > 0
        seen[r.uid].append((r["first"], r["first"] + r["words"]))
    for uid, spans in seen.items():
        covered = defaultdict(int)
        for a, b in spans:
            for x in range(a, b):
                covered[x] += 1
        assert max(covered.values()) <= mx.MAX_REPEAT
    # each slot has one source, and is filled whole but for each source's last
    slots, words, by_source = {}, defaultdict(int), defaultdict(list)
    for r in rows:
        assert slots.setdefault(r.slot, r.rn) == r.rn
        words[r.slot] += r.words
    for s, rn in slots.items():
        by_source[rn].append(s)
    block = max(words.values())
    above = 1 << (len(slots) - 1).bit_length()
    for mine in by_source.values():
        assert sum(words[s] < block for s in mine) <= 1
        # the slots of a source are spread: the longest wait is a few times the even one
        mine = sorted(mine)
        gaps = [b - a for a, b in zip(mine, mine[1:], strict=False)]
        assert not gaps or max(gaps) <= 4 * above / len(mine)


def test_tiny_sources_beside_a_huge_one(spark, tmp_path):
    """The query itself: blocks of 16 words, sources of three."""
    from guardspark.llm import catalog

    rows = [(i, "w " * 20_000, "huge", "en") for i in range(100)] + [(1000 + i, "w w w", f"tiny{i}", "en") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["op9_mix_sources"](spark, str(tmp_path)).collect()
    assert {g.taken for g in got if g.doc_id >= 1000} == {9} and {g.target for g in got if g.doc_id >= 1000} == {9.0}
    assert sum(g.taken for g in got) == 2_000_060


def test_documents_come_in_the_order_of_the_schedule(spark):
    docs = docs_df(spark, [(i, "w " * 50, "a" if i % 3 else "b") for i in range(600)])
    got = [r.source for r in mx.mixed_documents(docs).collect()]
    # every stretch of the mix holds both sources in their shares
    share = got.count("a") / len(got)
    for k in range(0, len(got) - 120, 60):
        assert abs(got[k : k + 120].count("a") / 120 - share) < 0.12


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i:05d}" if i % 5 else None) for i in range(3000)]
    check(spark, rows)


def test_mixed_documents_repeat_whole_rows(spark):
    docs = docs_df(spark, awkward())
    out = mx.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[(r.doc_id, r.text)] += 1
    assert counts and all(1 <= c <= 6 for c in counts.values())  # the repeated row has two
    assert all(t and t.strip() for _, t in counts)


def test_mixed_documents_give_every_source_its_target(spark):
    # a tiny source and one long document beside a huge source (blocks of several words)
    big = "w " * 5000
    rows = [(i, big, f"s{i % 3}") for i in range(300)] + [(1000 + i, "w", f"tiny{i}") for i in range(20)]
    rows += [(2000, "w " * 400_000, "whole")] + [(3000 + i, "w " * 7, "small") for i in range(5)]
    sizes = totals(rows)
    want, longest = water_fill(sizes), defaultdict(int)
    for _, t, s in rows:
        longest[s] = max(longest[s], len(t.split()))
    got = defaultdict(int)
    for r in mx.mixed_documents(docs_df(spark, rows)).select("source", "text").collect():
        got[r.source] += len(r.text.split())
    for s in sizes:
        assert want[s] - 0.51 <= got[s] < want[s] + longest[s] + 0.5, (s, want[s], got[s])
    assert {got[f"tiny{i}"] for i in range(20)} == {3} and got["small"] == 105


def test_empty_table(spark):
    assert mx.taken_words(docs_df(spark, [])).count() == 0
    assert mx.mixed_documents(docs_df(spark, [])).count() == 0
