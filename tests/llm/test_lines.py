"""Operator 12 against plain counts; filters, insertions and deletions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, docs_df

from guardspark.llm import op12_lines as L


def brute(rows, corpus, min_docs):
    """(doc_id, n_lines, n_dropped, kept text) of each row."""
    split = lambda t: (t or "").encode().split(b"\n")
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    counts = Counter()
    for t in corpus:
        counts.update({key(x) for x in split(t)})
    out = []
    for i, t in rows:
        kept = [x for x in split(t) if not key(x) or counts[key(x)] < min_docs]
        out.append((i, len(split(t)), len(split(t)) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    lines = ["Home | About", "  home | ABOUT\t", "", "   ", "ÄÖ line", "äö line", *(f"line {i}" for i in range(12))]
    return [(i, "\n".join(r.choice(lines) if r.random() < 0.5 else f"own {seed} {i} {k}" for k in range(r.randint(0, 9)))) for i in range(n)]


def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in frame.collect()), key=str)


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_awkward_rows(spark, rows):
    docs = docs_df(spark, rows + rows[-2:])
    pairs = [(i, t) for i, t, _ in rows + rows[-2:]]
    out = L.deduplicated(docs, min_docs=3)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert found(out) == brute(pairs, [t for _, t in pairs], 3)
    assert all(r.text is None for r in out.where("doc_id = 1").collect())


def test_clashing_names(spark):
    docs = df(spark, corpus(1)).selectExpr("doc_id", "text", "1 AS n_lines", "2 AS __row", "3 AS `__lines`")
    out = L.deduplicated(docs, min_docs=5)
    assert out.columns == ["doc_id", "text", "n_lines", "__row", "__lines", "n_lines_", "n_dropped"] and out.count() == 60


def test_shards_heavy_keys_and_parts_change_nothing(spark, monkeypatch):
    rows = corpus(2, 150)
    want = brute(rows, [t for _, t in rows], 10)
    for shard_keys, probe_rows, heavy in ((1 << 16, 1 << 19, 10_000), (16, 8, 3), (64, 20, 1)):
        monkeypatch.setattr(L, "SHARD_KEYS", shard_keys)
        monkeypatch.setattr(L, "PROBE_ROWS", probe_rows)
        monkeypatch.setattr(L, "HEAVY", heavy)
        assert found(L.deduplicated(df(spark, rows))) == want


def counts(index):
    return sorted((bytes(r.key), r.n_docs) for r in index.counts().collect())


def test_insertions_and_deletions_are_reversible(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(L, "SHARD_KEYS", 40)  # several shards, split on the way
    a, b, c = corpus(3), corpus(4), corpus(5, 40)
    base = L.inserted(L.LineIndex.empty(spark, min_docs=10), df(spark, a))
    grown = L.inserted(L.inserted(base, df(spark, b)), df(spark, c))
    assert grown.shards > base.shards
    back = L.deleted(L.deleted(grown, df(spark, b)), df(spark, c))
    texts = lambda *groups: [t for g in groups for _, t in g]
    assert counts(back) == counts(base)
    assert counts(grown) == counts(L.inserted(L.LineIndex.empty(spark, min_docs=10), df(spark, a + b + c)))
    probe = corpus(6)
    assert found(L.deduplicated(df(spark, probe), grown)) == brute(probe, texts(a, b, c), 10)
    assert found(L.deduplicated(df(spark, probe), base)) == found(L.deduplicated(df(spark, probe), back)) == brute(probe, texts(a), 10)
    # the filters hold exactly the common keys, through all changes
    for index in (grown, back):
        filters = {r.shard: L.CuckooFilter.read(bytes(r.filter)) for r in index.filters().collect()}
        common = Counter(r.shard for r in index.counts().where("n_docs >= 10").collect())
        assert {s: int((f.table > 0).sum()) for s, f in filters.items()} == {s: common[s] for s in filters}
    grown.save(str(tmp_path / "index"))
    again = L.LineIndex.load(spark, str(tmp_path / "index"))
    assert found(L.deduplicated(df(spark, probe), again)) == brute(probe, texts(a, b, c), 10)
    with pytest.raises(Exception, match="never inserted"):
        L.deleted(base, df(spark, [(1, "a line nobody wrote")])).counts().count()


def test_filter_keeps_every_key():
    keys = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(30_000)), dtype=np.uint8).reshape(-1, 16)
    mine, others = keys[:20_000], keys[20_000:]
    f = L.CuckooFilter.of(mine)
    assert f.contains(mine).all() and f.contains(others).mean() < 0.001
    assert 4 * 2 * len(f.table) < 4 * len(mine)
    f.delete(mine[:15_000])
    f = L.CuckooFilter.read(f.blob())
    assert f.contains(mine[15_000:]).all() and f.contains(mine[:15_000]).mean() < 0.001
    assert int((f.table > 0).sum()) == 5_000
    full = L.CuckooFilter.sized(4)
    assert not full.insert(mine[:500])  # too small: says so
