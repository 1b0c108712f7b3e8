"""Large lexicons as tables.

A lexicon is a DataFrame (lexicon, category, pos, phrase) of any size, instead of an
alternation in the plan.  Counts are those of the alternation of a category's phrases in
order of ``pos``: substrings, ignoring case, leftmost first, without overlap.

Index: each phrase is filed under one anchor, the substring of ``GRAM`` characters that is rarest
in the lexicon (a shorter phrase is its own anchor).  A text's distinct substrings of those lengths meet the
anchors by an equi-join, so a phrase meets only texts that hold its anchor; Spark broadcasts the anchors
if their bytes allow, else both sides shuffle by the anchor.  What meets is gathered per
text and category, and one alternation of just those phrases decides exactly: a phrase whose anchor is missing cannot occur, and
phrases that do not occur do not change which one is found first.

Case is folded on both sides by lower-casing, with the two characters that match an ASCII
letter without lower-casing to it.  Null and empty phrases are ignored, a phrase listed twice counts once, a null or
empty text has no hits.  Texts with the same key share candidates, never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.operators import guards as G

#: Characters of an anchor.
GRAM = 4

LEXICON_SCHEMA = "lexicon string, category string, pos int, phrase string"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), "ıſ", "is")


def from_lists(spark, **lexicons: dict[str, list[str]]) -> DataFrame:
    """The table of phrase lists given as Python values."""
    rows = [(lex, c, i, p) for lex, cats in lexicons.items() for c, phrases in cats.items() for i, p in enumerate(phrases)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def _grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters, overlapping ones too."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _sized(text: Column, size: Column, sizes: list[int]) -> Column:
    out = None
    for n in sizes:
        out = F.when(size == n, _grams(text, n)) if out is None else out.when(size == n, _grams(text, n))
    return out


def anchored(lexicon: DataFrame) -> DataFrame:
    """(lexicon, category, pos, phrase, size, anchor): folded phrases under their anchors."""
    phrase = fold(F.col("phrase"))
    size = F.least(F.length(phrase), F.lit(GRAM))
    phrases = (
        lexicon.where(F.length("phrase") > 0)
        .select("lexicon", "category", phrase.alias("phrase"), size.alias("size"), "pos")
        .groupBy("lexicon", "category", "phrase", "size")
        .agg(F.min("pos").alias("pos"))
    )
    grams = phrases.select("phrase", "size").distinct()
    grams = grams.select("phrase", "size", F.explode(F.array_distinct(_sized(F.col("phrase"), F.col("size"), list(range(1, GRAM + 1))))).alias("gram"))
    common = grams.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("phrase").orderBy("n", F.xxhash64("gram"), "gram")
    chosen = (
        grams.join(common, ["size", "gram"])
        .withColumn("rank", F.row_number().over(rarest))
        .where("rank = 1")
        .select("phrase", F.col("gram").alias("anchor"))
    )
    return phrases.join(chosen, "phrase").select("lexicon", "category", "pos", "phrase", "size", "anchor")


def _quoted(phrase: Column) -> Column:
    return F.regexp_replace(phrase, F.lit(r"([^\p{L}\p{N}\p{M} ])"), F.lit(r"\\$1"))


def candidates(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, found): per text with candidates, the alternation of each
    category's phrases whose anchors the text holds."""
    anchors = anchored(lexicon)
    sizes = sorted(r.size for r in anchors.select("size").distinct().collect())  # GRAM values at most
    folded = texts.select(F.col(key).alias("__key"), fold(F.col(text)).alias("__folded"))
    if not sizes:
        sizes = [GRAM]
    grams = F.array(*[F.struct(F.lit(n).alias("size"), F.array_distinct(_grams(F.col("__folded"), n)).alias("grams")) for n in sizes])
    held = folded.select("__key", F.inline(grams)).select("__key", F.col("size").alias("__size"), F.explode("grams").alias("__gram"))
    met = (
        held.join(anchors, (F.col("__size") == F.col("size")) & (F.col("__gram") == F.col("anchor")))
        .groupBy("__key", "lexicon", "category")
        .agg(F.collect_set(F.struct("pos", "phrase")).alias("phrases"))
    )
    ordered = F.transform(F.array_sort("phrases"), lambda p: _quoted(p["phrase"]))
    return (
        met.select("__key", F.struct("lexicon", "category", F.array_join(ordered, "|").alias("any")).alias("one"))
        .groupBy("__key")
        .agg(F.collect_list("one").alias("found"))
    )


def _counted(texts: DataFrame, key: str, text: str, lexicon: DataFrame, how: str) -> DataFrame:
    """``texts`` with ``__hits``: array of (lexicon, category, hits), hits above 0."""
    found = candidates(texts, key, text, lexicon)
    joined = texts.join(found, F.col(key).eqNullSafe(F.col("__key")), how).withColumn("__folded", fold(F.col(text)))

    def hits(c: Column) -> Column:
        n = F.regexp_count(F.col("__folded"), c["any"]).cast("long")
        return F.struct(c["lexicon"].alias("lexicon"), c["category"].alias("category"), n.alias("hits"))

    counted = F.filter(F.transform("found", hits), lambda h: h["hits"] > 0)
    return joined.withColumn("__hits", counted).drop("__key", "found", "__folded")


def lexicon_hits(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """One row (key, lexicon, category, hits) for each category with hits."""
    return _counted(texts, key, text, lexicon, "inner").select(key, F.inline("__hits"))


def guard_result(
    texts: DataFrame, key: str, text: str, guard: type[G.ToxicContent] | type[G.TopicRestriction], conf: dict, lexicon: DataFrame, out: str = "r"
) -> DataFrame:
    """C3 or C4 with the phrases of ``lexicon`` (its rows of the guard's configured categories,
    under any ``lexicon`` name): ``texts`` with the result struct ``out``."""
    rule = guard(conf)
    wanted = list(conf.get(rule.list_key, []))
    rule.lexicon = {c: [] for c in wanted}
    mine = lexicon.where(F.col("category").isin(wanted)).withColumn("lexicon", F.lit(""))
    df = _counted(texts, key, text, mine, "left")
    by_category = F.map_from_entries(F.transform(F.coalesce("__hits", F.array().cast("array<struct<lexicon:string,category:string,hits:bigint>>")), lambda h: F.struct(h["category"], h["hits"])))
    df = df.withColumn("__by", by_category)

    def fact(name: str) -> Column:
        return F.coalesce(F.try_element_at("__by", F.lit(name.removeprefix("n_"))), F.lit(0).cast("long"))

    return df.withColumn(out, rule.score(F.col(text), fact)).drop("__hits", "__by")
