"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, awkward, crc_mod, docs_df, shingles

import __spark_entry__ as entry
import corpus_pipeline
from guardspark.llm import catalog, op2_toxicity, op8_tokens, op9_mix, oracle
from guardspark.llm.common import crc_mod as crc_col
from guardspark.llm.common import staged, table
from oracle_check import compare
from pyspark.sql import functions as F

CONTRACT = {
    "op1_main_text": "page_id url text n_chars",
    "op2_toxic_segments": "doc_id held_out score predicted",
    "op3_near_duplicates": "doc_id n_shingles component_id kept",
    "op4_chat_windows": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op5_lattice_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_secret_links": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_mix_sources": "doc_id size source_size target taken",
    "op10_decontaminate_benchmark": "doc_id",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    report = compare(spark, SF, [name], verbose=False)
    assert report[name][0] == "match" and report[name][1] > 0


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_returns_its_columns(spark, name):
    columns = catalog.QUERIES[name](spark, SF).columns
    assert set(CONTRACT[name].split()) <= set(columns) and len(set(columns)) == len(columns)


def test_all_are_registered():
    assert set(CONTRACT) == set(catalog.QUERIES) and set(CONTRACT) | {"pipeline"} <= set(entry.queries())
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    held = {name: None for name, _ in corpus_pipeline.STAGES}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = held[name] = staged(stage(spark, current, SF), "test-stage")
    names = [name for name, _ in corpus_pipeline.STAGES]
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = {name: Counter(r.doc_id for r in held[name].select("doc_id").collect()) for name in names}
    assert all(held[name].columns == docs.columns for name in names[:-1])
    # toxicity: the scores of the same model decide
    learns = crc_col(F.col("doc_id"), 5) != 0
    model = op2_toxicity.fit(docs, table(spark, SF, "labels"), learns)
    assert ids["drop_toxic"] == Counter(i for i, t in text.items() if model.score(model.evidence(t)) < 0.5)
    # near-duplicates: all pairs; the smallest id of each group stays
    kept = sorted(ids["drop_toxic"])
    sets = {i: shingles(text[i]) for i in kept}
    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(kept):
        for b in kept[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    heads = [i for i in kept if find(i) == i]
    assert ids["drop_near_duplicates"] == Counter(heads)
    # benchmark leaks: all windows of all items
    import test_decontaminate as td

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    marks = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in items}
    clean = []
    for i in heads:
        w = (text[i] or "").lower().split()
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near = [(j, t) for j, t in items if marks[j] & have]
        if not near or not td.brute([(i, text[i])], near)[i]:
            clean.append(i)
    assert ids["drop_benchmark_leaks"] == Counter(clean)
    # the mix: copies follow the words taken
    taken = {r.doc_id: (r.taken, r["size"]) for r in op9_mix.taken_words(held["drop_benchmark_leaks"]).collect()}
    words = {s: n for s, n in held["drop_benchmark_leaks"].groupBy("source").count().collect()}
    copies = sum(ids["mix_sources"].values())
    want = sum(round(t / s) for t, s in taken.values() if s)
    assert abs(copies - want) <= 2 * len(words) and max(ids["mix_sources"].values()) <= 3
    # token files: the tokenizer's own ids, in order
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op8_tokens.default_tokenizer())
    at, digest = 0, []
    for i in sorted(ids["mix_sources"].elements()):
        n = tok.encode(text[i], add_special_tokens=False).ids + [op8_tokens.END_ID]
        digest.append((i, at, len(n), zlib.crc32(np.asarray(n, "<u4").tobytes())))
        at += len(n)
    rows = held["write_token_files"].select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == digest


def test_held_out_rows_follow_the_id(spark):
    for name, m, r in (("op2_toxic_segments", 5, 0), ("op5_lattice_scores", 7, 2)):
        got = catalog.QUERIES[name](spark, SF).select("doc_id", "held_out").collect()
        assert all(g.held_out == (crc_mod(g.doc_id, m) == r) for g in got)


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_every_stage_takes_awkward_rows_and_empty_tables(spark, rows):
    docs = docs_df(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert set(got) <= {(i, t) for i, t, _ in rows}
        if name == "drop_near_duplicates":
            # blank texts, rows without an id and unlike texts stay
            assert all(got[(i, t)] for i, t, _ in rows if i in (None, 1, 2, 3, 6, 7, 10, 15, 16))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == len(rows)
