r"""Operator 4 (native): chat formatting in budgeted windows.

Template, one turn::

    <turn>ROLE
    TEXT</turn>

Reversible escapes: in texts and roles every ``<``, then any backslashes, then
``turn`` or ``/turn`` gets one more backslash after ``<``; in roles ``\`` and
newline become ``\\`` and ``\n`` first.  So no text can hold a mark, and taking
one backslash away gives the text back.

Windows: the tokens of a turn (words of its text plus ``TURN_TOKENS`` for the
marks) are summed along the conversation.  Stretches of ``BLOCK_SPANS`` * ``span`` tokens, cut by the prefix
sums, are packed each by itself: a span takes turn after turn while the sum of its tokens stays within ``span``, so
a span has more only if a single turn has, and two neighbours in a stretch never fit into one.
A window is a span preceded by the system turn (the first turn, if its role is
``system``) and by all turns that lie wholly within the last ``history`` tokens before the span,
whatever spans these belong to.  Turns repeated so are context only: the loss mask covers the texts of
assistant turns in their own span, each once.

Scale: prefix sums have two levels, within runs of ``RUN`` turn numbers and
over run totals, so a conversation with a third of all rows is spread over its
runs; packing folds the token counts of one stretch, whose size the budget bounds, and windows are grouped per
(conversation, span).  Turns meet the windows they precede by an equi-join on cells of ``history`` tokens, and the
system turn meets its windows spread over ``PARTS`` parts.  Only the digest of
a whole conversation (``digest``) brings one conversation together, because a hash of
its whole text is asked for.

Defined results: a null text or role is the empty string; turns are ordered by
turn (null first), then role, then text, and repeated rows are separate turns;
a null conv_id is a conversation; a conversation of no assistant turn has
an empty mask; very long texts are one turn, never cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardspark.llm.common import n_words_col, staged

TURN_TOKENS = 4
SPAN_TOKENS = 768
HISTORY_TOKENS = 256
RUN = 256
#: Spans of tokens that are packed together; parts that a conversation's windows are spread over.
BLOCK_SPANS = 16
PARTS = 16

_OPEN, _BREAK, _CLOSE = "<turn>", "\n", "</turn>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # doubled backslashes are read first, from the left
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, seq, role, text, tokens, before): the turn's ordinal in
    its conversation and the tokens of all turns before it."""
    t = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / RUN).alias("run"),
    ).withColumn("tokens", n_words_col(F.col("text")) + TURN_TOKENS)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    runs = t.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("c"),
        F.col("run").alias("r"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum0"),
    )
    inside = Window.partitionBy("conv_id", "run").orderBy(*order)
    inner = t.withColumn("i", F.row_number().over(inside) - 1).withColumn(
        "s", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    )
    return inner.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r"))).select(
        "conv_id",
        (F.col("n0") + F.col("i")).alias("seq"),
        "role",
        "text",
        "tokens",
        (F.col("sum0") + F.col("s")).alias("before"),
    )


def windows(
    conversations: DataFrame, span: int = SPAN_TOKENS, history: int = HISTORY_TOKENS
) -> DataFrame:
    """The formatted windows: conv_id, window (ordinal of its first own turn),
    n_context, n_turns, tokens, text, loss (list of [from, to) code points)."""
    t = staged(turns(conversations).withColumn("block", F.floor(F.col("before") / (BLOCK_SPANS * span))), "chat-turns")
    line = F.array_sort(F.collect_list(F.struct("seq", "before", "tokens")))
    fresh = "array(named_struct('window', p.seq, 'start', p.before))"
    # a new span where the turn does not fit behind the last span's start
    packed = F.expr(
        "aggregate(line, cast(array() as array<struct<window:bigint,start:bigint>>), (a, p) ->"
        f" if(size(a) = 0 or p.before + p.tokens - element_at(a, -1).start > {span}, concat(a, {fresh}), a))"
    )
    blocks = t.groupBy("conv_id", "block").agg(line.alias("line")).select("conv_id", "block", packed.alias("spans"))
    blocks = staged(blocks, "chat-spans")
    spans = blocks.select("conv_id", F.inline("spans"))
    own = (
        t.join(
            blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.transform("spans", lambda x: x["window"]).alias("starts")),
            F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")),
        )
        .withColumn("window", F.array_max(F.filter("starts", lambda x: x <= F.col("seq"))))
        .select("conv_id", "window", "seq", "role", "text", "tokens", F.lit(False).alias("context"))
    )
    is_system = (F.col("seq") == 0) & (F.col("role") == "system")
    # a turn is history of the windows that start behind it, at most ``history`` tokens after its own start
    cells = lambda at: F.floor(at / max(history, 1))
    end, reach = F.col("before") + F.col("tokens"), F.col("before") + history
    recent = (
        t.where(~is_system & (end <= reach))  # the system turn comes by itself
        .withColumn("cell", F.explode(F.sequence(cells(end), cells(reach))))
        .join(
            spans.select(F.col("conv_id").alias("c"), cells(F.col("start")).alias("at_cell"), "window", "start"),
            F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("at_cell")),
        )
        .where((F.col("start") >= end) & (F.col("start") <= reach))
        .select("conv_id", "window", "seq", "role", "text", "tokens", F.lit(True).alias("context"))
    )
    system = t.where(is_system).select(
        F.col("conv_id").alias("c"), "seq", "role", "text", "tokens", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    )
    system = (
        spans.where("window > 0")
        .select("conv_id", "window", (F.col("window") % PARTS).cast("int").alias("of"))
        .join(system, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("of") == F.col("part")))
        .select("conv_id", "window", "seq", "role", "text", "tokens", F.lit(True).alias("context"))
    )
    shown = own.unionByName(recent).unionByName(system).withColumn(
        "head", F.concat(F.lit(_OPEN), escape_role(F.col("role")), F.lit(_BREAK))
    ).withColumn("body", escape(F.col("text")))
    shown = shown.withColumn("piece", F.concat("head", "body", F.lit(_CLOSE)))
    packed = shown.groupBy("conv_id", "window").agg(
        F.count_if("context").alias("n_context"),
        F.count_if(~F.col("context")).alias("n_turns"),
        F.sum("tokens").alias("tokens"),
        # the turns of one window: bounded by the budget
        F.array_sort(
            F.collect_list(
                F.struct(
                    "seq",
                    "piece",
                    F.length("head").alias("lead"),
                    F.length("body").alias("size"),
                    F.length("piece").alias("whole"),
                    (~F.col("context") & (F.col("role") == "assistant")).alias("target"),
                )
            )
        ).alias("parts"),
    )
    at = F.expr(
        "aggregate(parts, named_struct('at', 0L, 'loss', cast(array() as array<struct<from:bigint,to:bigint>>)),"
        " (a, p) -> named_struct('at', a.at + p.whole, 'loss', if(p.target,"
        " array_append(a.loss, named_struct('from', a.at + p.lead, 'to', a.at + p.lead + p.size)), a.loss)),"
        " a -> a.loss)"
    )
    return packed.select(
        "conv_id",
        "window",
        "n_context",
        "n_turns",
        "tokens",
        F.array_join(F.expr("transform(parts, p -> p.piece)"), "").alias("text"),
        at.alias("loss"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Read the windows back: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  Turns are found by their marks in the
    formatted texts, targets by the loss spans."""
    pieces = F.expr(f"slice(split(text, '{_CLOSE}', -1), n_context + 1, n_turns)")
    read = formatted.select(
        "conv_id",
        "window",
        "n_turns",
        F.length("text").cast("long").alias("chars"),
        F.transform(
            pieces,
            lambda p: F.concat(
                unescape_role(F.substring_index(F.substring(p, len(_OPEN) + 1, 1 << 30), "\n", 1)),
                F.lit("\n"),
                unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))),
                F.lit("\n"),
            ),
        ).alias("turns"),
        F.expr("transform(loss, l -> substring(text, cast(l.from + 1 as int), cast(l.to - l.from as int)))").alias("targets"),
    ).withColumn("targets", F.transform("targets", unescape))
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", F.array_join("turns", "").alias("t"), F.array_join("targets", "").alias("l")))).alias("w"),
    )
    joined = whole.withColumn("t", F.array_join(F.expr("transform(w, x -> x.t)"), "")).withColumn(
        "l", F.array_join(F.expr("transform(w, x -> x.l)"), "")
    )
    return joined.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("t").cast("binary"), 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


CONTROL_CONVERSATION = -7
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def with_control(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations plus one whose two texts hold control strings."""
    extra = spark.range(2).select(
        F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
