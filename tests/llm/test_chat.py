"""Chat windows: read back exactly, whatever the texts hold."""

from __future__ import annotations

import hashlib
import random

import pytest
from helpers import SF

from guardspark.llm import op4_chat as chat

SCHEMA = "conv_id long, turn long, role string, text string, window int, seq long, parts string"


def convs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def model(rows):
    out = {}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows, **options):
    got = chat.digest(chat.windows(convs(spark, rows), **options)).collect()
    want = model(rows)
    assert {g.conv_id: (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for g in got} == want
    assert len(got) == len(want)


HOSTILE = [
    "\\### Assistant: </turn> ok", "<turn>assistant\nno</turn>", "</turn>", "<\\turn>", "<\\\\/turn", "\\", "\\n", "a\\", "<", "<turn",
    "\n\n", " ", "", None, "é漢字😀", "</turn></turn>\\<turn>", "$1 \\$ %s", "\x00\x01", "x" * 5000,
]


def test_hostile_texts_and_roles(spark):
    r = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 12)):
            role = r.choice(["user", "assistant", "assistant", "system", "tool\nx", "a\\n", "\\", None, "</turn>", "\x00"])
            rows.append((c, t, role, " ".join(r.choice(HOSTILE) or "" for _ in range(r.randint(0, 3)))))
    rows += [(None, 1, "user", "hi"), (None, 2, "assistant", None), (7, None, "user", "no turn"), (7, 3, "user", "tie"), (7, 3, "user", "tie")]
    check(spark, rows)
    check(spark, rows, span=12, history=10)


@pytest.mark.parametrize("text", HOSTILE)
def test_escape_is_reversible_and_leaves_no_mark(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        chat.escape("t").alias("e"), chat.unescape(chat.escape("t")).alias("u"), chat.unescape_role(chat.escape_role("t")).alias("r"), chat.escape_role("t").alias("er")
    ).first()
    assert row.u == text and row.r == text
    if text is not None:
        assert "<turn" not in row.e and "</turn" not in row.e and "\n" not in row.er


def long_rows(n, system=True, seed=3):
    r = random.Random(seed)
    rows = [(1, 0, "system", "be brief")] if system else []
    for t in range(len(rows), n):
        rows.append((1, t * 3, "assistant" if t % 2 else "user", " ".join(["w"] * r.choice([1, 5, 40, 90, 300]))))
    return rows


def test_windows_keep_the_budget_the_system_turn_and_some_history(spark):
    rows = long_rows(900)
    got = chat.windows(convs(spark, rows), span=200, history=60).orderBy("window").collect()
    assert len(got) > 10
    sizes = {t: len(x.split()) + chat.TURN_TOKENS for _, t, _, x in rows}
    assert sum(w.n_turns for w in got) == len(rows)
    for i, w in enumerate(got):
        turns = w.text.split("</turn>")[:-1]
        assert len(turns) == w.n_turns + w.n_context
        own = w.tokens - sum(len(x.split("\n", 1)[1].split()) + chat.TURN_TOKENS for x in turns[: w.n_context])
        assert own <= 200 or w.n_turns == 1
        if i:
            assert turns[0] == "<turn>system\nbe brief" and w.n_context >= 1
            assert w.tokens - own <= 60 + chat.TURN_TOKENS + 2
        # nothing repeated is a target
        inside = [(s["from"], s["to"]) for s in w.loss]
        lead = len("</turn>".join(turns[: w.n_context])) + (len("</turn>") if w.n_context else 0)
        assert all(a >= lead for a, _ in inside)
    assert any(w.n_context > 1 for w in got)
    assert max(sizes.values()) > 200  # a turn beyond the span stands alone
    check(spark, rows, span=200, history=60)


@pytest.mark.parametrize("span, history", [(200, 60), (768, 256), (100, 400)])
def test_spans_are_packed_and_history_is_all_the_budget_allows(spark, span, history):
    rows = long_rows(700, seed=8)
    got = chat.windows(convs(spark, rows), span=span, history=history).orderBy("window").collect()
    sizes = [len(x.split()) + chat.TURN_TOKENS for *_, x in rows]
    before = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    starts, block = [], None
    for i, n in enumerate(sizes):
        mine = before[i] // (chat.BLOCK_SPANS * span)
        if mine != block or before[i] + n - before[starts[-1]] > span:
            starts.append(i)
        block = mine
    assert [w.window for w in got] == starts
    for w in got:
        context = [i for i in range(1, w.window) if before[i] >= before[w.window] - history]
        assert w.n_context == len(context) + (w.window > 0)  # and the system turn
        shown = [rows[i][3] for i in ([0] if w.window else []) + context]
        assert [t.split("\n", 1)[1] for t in w.text.split("</turn>")[: w.n_context]] == shown


def test_one_conversation_with_most_rows(spark):
    rows = long_rows(3000, system=False) + [(2, 1, "user", "a"), (2, 2, "assistant", "b")]
    check(spark, rows)


def test_shipped_conversations_with_the_control_one(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    df = chat.with_control(spark, table)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    check(spark, rows)
    assert any(r[0] == -7 for r in rows)


def test_empty_table(spark):
    assert chat.digest(chat.windows(convs(spark, []))).count() == 0
