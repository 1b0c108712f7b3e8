"""Operator 9 (native): mixing sources to target weights.

Method: a low-discrepancy schedule.  Each source takes its target, in words, from its shuffled
token line, which repeats up to ``max_repeat`` times; the line is cut into blocks of equal size, the
last of each source shorter.  The blocks of all sources, side by side, cut the unit interval by their
cumulative weights, and the van der Corput point of block number r (its bits reversed) says
when it comes: the slots of a source are spread evenly over the mix.  The slots of each source are ranked by
time, and rank k takes the k-th block of the line.  The schedule is a pure function of the data
and the seed: reruns agree.

Every source gets its target to the word, whatever its size beside the others: a block has
ceil(total / ``SLOTS``) words, and a source of less than a block has one slot with its words.

Scale: the word counts are taken once and staged as narrow rows; every later
step moves only (ids, sizes).  A document's place in its source's shuffled
line is a two-level prefix sum (per hash bucket, then within the bucket), so a
source that holds a third of all rows is spread over ``BUCKETS`` groups.  Sources are numbered, levelled and laid side by side by
two-level prefix sums too, so millions of them are no single task's work.  There are at most ``SLOTS`` slots and one a source.

Defined results: a null text has size 0; null source is a source of its own
and comes last; a document of size 0 is taken 0 times; repeated rows are
separate documents; a null doc_id is kept and shuffled as the text ''; very long texts are cut by blocks like any
other; equal hashes are ordered by id, size and row; other columns are ignored (``mixed_documents`` keeps all); an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardspark.llm.common import free_names, n_words_col, staged
from guardspark.operators.prefix import running

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Whole blocks in the mix, about; a block has ceil(total / SLOTS) words.
SLOTS = 1 << 17
#: Hash buckets of each source's shuffled line (first three hex digits).
BUCKET_DIGITS = 3


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Narrow rows (uid, doc_id, source, size, h) of all documents, staged."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            "source",
            n_words_col(F.col("text")).alias("size"),
            F.md5(key.cast("binary")).alias("h"),
        ),
        "mix-sizes",
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """One row per source: (source, rn, source_size, weight, target).

    Targets share the total by weight; a target stops at ``max_repeat`` times
    the source's size and the excess is shared again by weight until none is
    above.  That fixed point is a water level: with sources ordered by
    cap / weight, the level before each source is (total - caps before it) /
    (weights from it on), and the capped ones are those the level reaches.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = running(per, [F.col("source").asc_nulls_last()], [], "mix-sources").withColumnRenamed("place", "rn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rn") % len(weights) + 1).cast("int"))
    capped = (
        named.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(max_repeat))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    ordered = running(capped, [F.col("ratio"), F.col("rn")], ["cap", "weight"], "mix-levels")
    sums = ordered.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    level = (F.lit(sums["total"]) - F.col("before_cap")) / (F.lit(sums["weight"]) - F.col("before_weight"))
    ordered = ordered.withColumn("level", level)
    free = ordered.where("ratio > level").agg(F.min(F.struct("ratio", "rn", "level")).alias("free")).select("free.level").first()
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.lit(free["level"]) * F.col("weight"))
    return ordered.select("source", "rn", "source_size", "weight", target.alias("target"))


def shuffled_line(sizes: DataFrame) -> DataFrame:
    """Each document's first word on its source's shuffled line (``start``)."""
    s = sizes.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    per_bucket = s.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("source").alias("o_source"),
        F.col("bucket").alias("o_bucket"),
        F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"),
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "uid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    s = s.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return s.join(
        offsets,
        F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")),
    ).select("uid", "doc_id", "source", "size", (F.col("offset") + F.col("inner")).alias("start"))


def _reversed_bits(r: Column, bits: int) -> Column:
    """The van der Corput point of ``r`` in base 2, times 2 ** bits."""
    return F.conv(F.reverse(F.lpad(F.bin(r), bits, "0")), 2, 10).cast("long")


def schedule(targets: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Rows (slot, rn, rank, line): the slots of the mix in order of time, each with its source, the
    rank among that source's slots and the words the source takes in all; and the
    number that all slots stay below."""
    line = F.floor(F.col("target") + 0.5).cast("long")
    per = targets.where(line > 0).select("rn", line.alias("line"), F.ceil(line / F.lit(block)).cast("long").alias("slots"))
    laid = running(per, [F.col("rn")], ["slots"], "mix-schedule")
    n = laid.agg(F.sum("slots")).first()[0] or 1
    bits = max(1, (n - 1).bit_length())
    cells = laid.withColumn("r", F.explode(F.sequence(F.col("before_slots"), F.col("before_slots") + F.col("slots") - 1)))
    timed = cells.select(_reversed_bits(F.col("r"), bits).alias("slot"), "rn", "line")
    # at most SLOTS slots and one of one source
    rank = F.row_number().over(Window.partitionBy("rn").orderBy("slot")) - 1
    return timed.select("slot", "rn", rank.cast("long").alias("rank"), "line"), 1 << bits


def _placed(
    sizes: DataFrame, targets: DataFrame, max_repeat: int, slots: int
) -> tuple[DataFrame, DataFrame, int, int]:
    """Each document on its source's line as often as the line repeats (rows rn, uid, size, at, line);
    the schedule; the block; the number above all slots."""
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, -(-total // slots))
    plan, above = schedule(targets, block)
    line = shuffled_line(sizes.where("size > 0")).join(
        targets.select(F.col("source").alias("t_source"), "rn", "source_size", F.floor(F.col("target") + 0.5).cast("long").alias("line")),
        F.col("source").eqNullSafe(F.col("t_source")),
    )
    at = line.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn(
        "at", F.col("epoch") * F.col("source_size") + F.col("start")
    )
    return at.where("at < line").select("rn", "uid", "doc_id", "size", "at", "line"), staged(plan, "mix-slots"), block, above


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    slots: int = SLOTS,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, pieces).

    ``pieces`` is the mix itself: rows (slot, rn, uid, first, words), the words
    [first, first + words) of document ``uid`` taken at ``slot``.
    """
    sizes = sized(docs, seed)
    targets = staged(source_targets(sizes, weights, max_repeat), "mix-targets")
    at, plan, block, _ = _placed(sizes, targets, max_repeat, slots)
    end = F.least(F.col("at") + F.col("size"), F.col("line"))
    pieces = at.withColumn("end", end).withColumn(
        "rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)))
    )
    lo = F.greatest(F.col("at"), F.col("rank") * F.lit(block))
    hi = F.least(F.col("end"), (F.col("rank") + 1) * F.lit(block))
    pieces = pieces.select("rn", "rank", "uid", (lo - F.col("at")).alias("first"), (hi - lo).alias("words"))
    return sizes, targets, pieces.join(plan.drop("line"), ["rn", "rank"])


def taken_words(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, slots: int = SLOTS
) -> DataFrame:
    """Per document row: uid, doc_id, source, size, source_size, target, taken."""
    sizes, targets, pieces = mix(docs, weights, max_repeat, slots)
    taken = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    return (
        sizes.join(taken, "uid", "left")
        .join(
            targets.select(F.col("source").alias("t_source"), "source_size", "target"),
            F.col("source").eqNullSafe(F.col("t_source")),
        )
        .select(
            "uid",
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix"
) -> DataFrame:
    """The documents the mix takes, in the order of its slots, each as often as
    the mix reaches it.

    Slots, ranks and blocks are those of ``mix``.  A document comes out whole at the slot that takes its first word; the one document per source at
    which the line ends comes out whole too, so a source has its target and less than that document's size more.
    Row ids are fixed by staging the documents.
    """
    row, slot, at = free_names(docs, "__row", "__slot", "__at")
    held = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    sizes = sized(held.select(F.col(row).alias("doc_id"), "source", "text"), seed)
    targets = staged(source_targets(sizes, weights, max_repeat), "mix-targets")
    places, plan, block, above = _placed(sizes, targets, max_repeat, SLOTS)
    places = places.withColumn("rank", F.floor(F.col("at") / block)).join(plan.drop("line"), ["rn", "rank"])
    copies = held.join(places.select(F.col("doc_id").alias(row), F.col("slot").alias(slot), F.col("at").alias(at)), row)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = (F.col(slot) * F.lit(parts) / F.lit(above)).cast("int")
    return copies.repartitionById(parts, stretch).sortWithinPartitions(slot, at).select(*docs.columns)
