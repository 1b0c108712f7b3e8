"""Operator 10 (native): benchmark decontamination by SimHash windows.

Words are the runs of other than white space of the lower-cased text; shingles
are five consecutive words.  An item of m words is looked for in windows of m
words (the whole document where that is shorter).  A window and an item are a
leak when their shingle multisets have a weighted Jaccard similarity
(sum of minima over sum of maxima) of at least ``SIM_PERCENT`` / 100.

1. A window of a shingles and an item of b can reach the similarity only where
   they share ``SIM_PERCENT`` * (a + b) / (100 + ``SIM_PERCENT``) or more.  A bitmap of the
   benchmark's shingle hashes drops the documents with fewer shingles in it than the smallest item asks
   for; the shingles of the others meet the benchmark's by hash, and the windows fingerprinted are all those that hold as many shingles of items of
   their size, wherever in the item these stand.
2. The window's fingerprint has 64 bits, each the majority of that bit over
   the window's shingles; items likewise.
3. Multi-index: the bits are cut into ``RADIUS + 1`` blocks; fingerprints within
   ``RADIUS`` bits agree in at least one block.  Windows and items of one size
   meet on (size, block, value); the Hamming distance confirms.  At similarity
   0.8 the distance is 9.7 on average with a standard deviation of 2.9.
4. Exact weighted similarity of every candidate decides.

Scale: texts are read once and never shuffled.  The bitmap has ``BITMAP_WORDS`` 64-bit words (half a MB)
at every size of the benchmark; its false hits only cost later work.  What passes, documents that hold benchmark shingles for the most
part, is staged as shingle hashes, and all later steps work on that; every join is Spark's own choice.  A passage in many
documents gives each of them its own windows, keyed by document: no hot key.  Very long texts are cut nowhere.

Defined results: null or blank texts and items leak nothing; an item of fewer
than five words is one shingle and is found as that word sequence; repeated
rows and ties are each judged; a null doc_id is allowed; items with equal text
are separate items; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import free_names, staged, words_col

WORDS = 5
SIM_PERCENT = 80
RADIUS = 20
#: 64-bit words of the bitmap of the benchmark's shingles; a power of two.
BITMAP_WORDS = 1 << 16


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles_col(text: Column, q: int) -> Column:
    """Hashes of all runs of ``q`` words, in order."""
    none = F.array().cast("array<bigint>")
    return _let(
        words_col(F.lower(text)),
        lambda w: F.when(F.size(w) < q, none).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - (q - 1)), lambda i: F.xxhash64(F.slice(w, i, q)))
        ),
    )


def item_table(benchmark: DataFrame) -> DataFrame:
    """Rows (item, item_id, m, q): one per benchmark row with words, staged."""
    words = words_col(F.lower(F.col("text")))
    return staged(
        benchmark.select(
            F.monotonically_increasing_id().alias("item"), "item_id", "text", F.size(words).alias("m")
        )
        .where("m > 0")
        .withColumn("q", F.least(F.lit(WORDS), F.col("m"))),
        "bench-items",
    )


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, n, fp) from rows (key, x): SimHash over the shingles x."""
    bits = [F.sum(F.shiftrightunsigned("x", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *bits)
    fp = F.lit(0).cast("long")
    for b in range(64):
        one = F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        fp = fp.bitwiseOR(one)
    return counted.select(key, "n", fp.alias("fp"))


def _blocks(fp: str) -> Column:
    """The RADIUS + 1 blocks of a fingerprint as structs (block, value)."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    parts = []
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        mask = (1 << (hi - lo)) - 1
        parts.append(
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit(mask)).alias("value"))
        )
    return F.explode(F.array(*parts))


def _starts(q: int) -> Column:
    """Runs (lo, hi) of the starts of windows that can be a leak, disjoint and
    ascending, of a row (m, ns, at): ``at`` has the places of the document's
    shingles that stand in an item of m words, ``ns`` is the number of all.

    A window holds ``need`` places if it begins at the first of ``need``
    neighbours or before, and ends at the last or behind; what begins at the
    place before the first of them, or earlier, belongs to the run before.
    """
    n = F.col("m") - (q - 1)
    # the window lies inside the document
    last = F.greatest(F.lit(0), F.col("ns") - n)
    shared = F.lit(SIM_PERCENT) * (F.least(F.col("ns"), n) + n)
    need = F.ceil(shared / F.lit(100 + SIM_PERCENT)).cast("int")

    def run(a: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("at", k - 1) + 1).otherwise(0)
        end = F.get("at", k + need - 1)
        return F.struct(F.greatest(end - n + 1, before, F.lit(0)).alias("lo"), F.least(a, last).alias("hi"))

    found = F.transform(F.slice("at", 1, F.greatest(F.lit(0), F.size("at") - need + 1)), run)
    return F.filter(found, lambda r: r["lo"] <= r["hi"])


def bitmap(places: DataFrame) -> Column:
    """The bitmap of the shingles ``x``, as a literal array of ``BITMAP_WORDS`` words."""
    word = F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")
    bit = F.expr("shiftleft(1L, cast(x & 63 as int))")
    set_words = places.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = [0] * BITMAP_WORDS
    for r in set_words.collect():  # BITMAP_WORDS rows at most
        words[r.word] = r.bits
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _in_bitmap(bits: Column, x: Column) -> Column:
    word = F.get(bits, F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int"))
    return F.getbit(word, x.bitwiseAND(F.lit(63)).cast("int")) == 1


def near_documents(docs: DataFrame, places: DataFrame, q: int) -> DataFrame:
    """Staged (doc_id, u, h, sh) of the documents that can leak an item: as many of their
    shingles are in the bitmap as the smallest item asks for.  ``u`` and ``h`` are the hashes of id
    and text; rows that agree in both are kept once."""
    smallest = (places.agg(F.min("m")).first()[0] or q) - (q - 1)
    bits = bitmap(places)
    need = F.ceil(F.lit(2 * SIM_PERCENT) * F.least(F.size("sh"), F.lit(smallest)) / F.lit(100 + SIM_PERCENT))
    own = docs.select("doc_id", F.xxhash64("doc_id").alias("u"), F.xxhash64("text").alias("h"), shingles_col(F.col("text"), q).alias("sh"))
    shared = F.size(F.filter("sh", lambda x: _in_bitmap(bits, x)))
    return staged(own.where((F.size("sh") > 0) & (shared >= need)).dropDuplicates(["u", "h"]), "bench-near")


def _leaks(docs: DataFrame, items: DataFrame, q: int) -> DataFrame:
    """Leaks of the items whose shingles have ``q`` words."""
    items = items.where(F.col("q") == q)
    item_rows = staged(
        items.select("item", "m", F.posexplode(shingles_col(F.col("text"), q)).alias("j", "x")), "bench-shingles"
    )
    places = item_rows.select("x", "m").distinct()
    own = near_documents(docs, places, q)
    hits = (
        own.select("doc_id", "u", "h", F.size("sh").alias("ns"), F.posexplode("sh").alias("i", "x"))
        .join(places, "x")
        .groupBy("doc_id", "u", "h", "m", "ns")
        # places in one document
        .agg(F.array_sort(F.collect_set("i")).alias("at"))
    )
    windows = staged(
        hits.select("doc_id", "u", "h", "m", F.explode(_starts(q)).alias("run"))
        .select("doc_id", "u", "h", "m", F.explode(F.sequence("run.lo", "run.hi")).alias("p"))
        .withColumn("win", F.monotonically_increasing_id()),
        "bench-windows",
    )
    rows = staged(
        windows.drop("doc_id").join(own.drop("doc_id"), ["u", "h"]).select(
            "win", F.explode(F.slice("sh", F.col("p") + 1, F.col("m") - (q - 1))).alias("x")
        ),
        "bench-window-shingles",
    )
    w = fingerprints(rows, "win").join(windows.select("win", "m"), "win")
    t = fingerprints(item_rows, "item").join(items.select("item", "m"), "item")
    met = (
        w.select("win", "m", F.col("n").alias("nw"), F.col("fp").alias("fw"), _blocks("fp").alias("k"))
        .join(t.select("item", "m", F.col("n").alias("ni"), F.col("fp").alias("fi"), _blocks("fp").alias("k")), ["m", "k"])
        .withColumn("distance", F.bit_count(F.col("fw").bitwiseXOR(F.col("fi"))))
        .where(F.col("distance") <= RADIUS)
        .select("win", "item", "nw", "ni", "distance")
        .distinct()
    )
    cw = rows.groupBy("win", "x").agg(F.count(F.lit(1)).alias("cw"))
    ci = item_rows.groupBy("item", "x").agg(F.count(F.lit(1)).alias("ci"))
    both = (
        met.join(cw, "win")
        .join(ci, ["item", "x"])
        .groupBy("win", "item", "nw", "ni", "distance")
        .agg(F.sum(F.least("cw", "ci")).alias("both"))
        .withColumn("either", F.col("nw") + F.col("ni") - F.col("both"))
        .where(F.col("both") * 100 >= F.col("either") * SIM_PERCENT)
    )
    return (
        both.join(windows, "win")
        .join(items.select("item", "item_id"), "item")
        .select(
            "doc_id", "h", "item", "item_id", F.col("p").alias("first_word"), F.col("m").alias("n_words"), "distance",
            (F.col("both") / F.col("either")).alias("similarity"),
        )
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best window for each (document, item) that leaks: doc_id, h (hash
    of the text), item, item_id, first_word, n_words, distance, similarity."""
    docs = docs.select("doc_id", "text")
    items = item_table(benchmark.select("item_id", "text"))
    sizes = sorted(r["q"] for r in items.select("q").distinct().collect())  # at most five values
    found = None
    for q in sizes or [WORDS]:
        part = _leaks(docs, items, q)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(
        F.struct("item_id", "first_word", "n_words", "distance", "similarity"),
        F.struct("similarity", -F.col("first_word")),
    )
    return found.groupBy("doc_id", "h", "item").agg(best.alias("best")).select("doc_id", "h", "item", "best.*")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_items, item_ids (ascending, comma-joined),
    contaminated."""
    per = (
        leaks(docs, benchmark)
        .groupBy("doc_id", "h")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            # at most the benchmark's items
            F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("item_ids"),
        )
        .select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "n_items", "item_ids")
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left").select(
        "doc_id",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    bad = staged(leaks(docs, benchmark).select("doc_id", "h").distinct(), "bench-leaks")
    d, h = free_names(docs, "__d", "__h")
    bad = bad.select(F.col("doc_id").alias(d), F.col("h").alias(h))
    same = docs["doc_id"].eqNullSafe(bad[d]) & (F.xxhash64(docs["text"]) == bad[h])
    return docs.join(bad, same, "left_anti")
