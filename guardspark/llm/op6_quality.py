r"""Operator 6 (native): quality rules with risk-controlled thresholds.

Metrics of every whole text: words, code points in words, symbol characters,
repeated lines, words inside repeated 8-word windows, distinct words and
upper-case letters.  Two fixed rules come first (``base_failed``).  Beyond them, each *rule* of ``RULES``
rejects a document whose metric lies beyond a cutoff.  How far the rules go is learnt for each
stratum (language), so that few good documents go:

* ``PATH`` orders all (rule, cutoff) pairs from the mildest on: first every rule's mildest cutoff, then every
  rule's next.  Its steps only ever add rejections.
* the holdout of a stratum is its labelled documents that pass the fixed rules
  and whose label is good (quality 1);
* a step is *safe* in a stratum when as many rejections as the rules up to it make among the n good documents of the
  holdout, or fewer, would have a probability of at most ``DELTA`` / strata
  if the true rate of false rejections were ``RISK`` (exact binomial tail);
* steps are tested in the order of the path until one is not safe (fixed-sequence testing: no correction
  within a stratum is needed), and the division by the strata tested is Bonferroni's correction; the last safe step is taken.

So, with confidence 1 - DELTA, no stratum loses more than RISK of its good documents to the learnt rules, all rules
together.  A stratum whose holdout is too small to prove anything (about 440 good rows with four strata) has no learnt rule on: no
document is judged by a cutoff that is not proven on its own language.  Whether a stratum is tested follows from n alone.  The path is fixed, not fitted.

Scale: the metrics are computed once, inside each row, without a shuffle, and
staged as narrow rows; calibration counts holdout documents per (stratum, first step that rejects them) with partial
aggregation and joins one step per stratum back.

Defined results: null and blank texts have no words and fail the fixed rule; very long texts are measured whole; a
null language counts as ''; labels other than 0 and 1, null ids and ids without
document are not used; an id labelled twice counts as good only if both say so;
without labels no learnt rule is on; repeated rows are judged each; a
comparison holds strictly beyond the cutoff (ties stay); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import WS_CHARS, staged, words_col

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RISK = 0.01
DELTA = 0.05

#: rule -> (metric, +1: high values are bad, -1: low values, cutoffs).
RULES: dict[str, tuple[str, int, tuple[float, ...]]] = {
    "symbols_per_word": ("symbols_per_word", 1, (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    "dup_lines": ("dup_line_share", 1, (0.2, 0.3, 0.4, 0.5, 0.7, 0.9)),
    "repeats": ("repeat_share", 1, (0.05, 0.1, 0.15, 0.2, 0.25)),
    "long_words": ("mean_word", 1, (6.0, 6.5, 7.0, 7.5, 8.0, 9.0)),
    "short_words": ("mean_word", -1, (2.0, 2.5, 3.0, 3.5, 4.0)),
    "few_distinct": ("distinct_share", -1, (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    "upper_case": ("upper_share", 1, (0.1, 0.2, 0.3, 0.5)),
}


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text."""
    marks = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def at_of(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.filter(
                F.sequence(F.lit(0), last),
                lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < last, same(i, i + 1)).otherwise(False),
            )
            return F.sort_array(F.transform(hit, lambda i: F.get(s, i)["at"]))

        def union(p: Column) -> Column:
            # each window adds what the next one does not cover
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(_let(by_hash, at_of), union)
        )

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(_let(marks, covered))


def metrics(docs: DataFrame) -> DataFrame:
    """Staged narrow rows (uid, doc_id, stratum, counts) of all documents."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    found = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.length(t).alias("n_chars"),
        # every symbol is left, all else dropped: both by one walk over the text
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("n_upper"),
        _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("l"),
        _let(
            words_col(F.col("text")),
            lambda w: F.struct(
                F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("repeat")
            ),
        ).alias("w"),
    )
    return staged(
        found.select(
            "uid",
            "doc_id",
            "lang",
            F.col("w.n").cast("long").alias("n_words"),
            F.col("word_chars").cast("long").alias("word_chars"),
            F.col("n_symbols").cast("long").alias("n_symbols"),
            (F.col("l.all") - F.col("l.distinct")).cast("long").alias("n_dup_lines"),
            F.col("w.repeat").cast("long").alias("n_repeat_words"),
            F.col("l.all").cast("long").alias("n_lines"),
            F.col("w.distinct").cast("long").alias("n_distinct"),
            F.col("n_upper").cast("long").alias("n_upper"),
        ),
        "quality-metrics",
    )


def _ratios(m: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return m.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
            "symbols_per_word": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "mean_word": F.col("word_chars") / n,
            "distinct_share": F.col("n_distinct") / n,
            "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        }
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact, by the recurrence of its terms in logs
    (a term of a large n underflows otherwise)."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + odds
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda a: F.least(F.lit(1.0), F.exp(a["sum"])))


def _levels(rule: str) -> list[float]:
    """A rule's cutoffs from the mildest to the most rejecting."""
    _, sign, grid = RULES[rule]
    return sorted(grid, reverse=sign > 0)


#: (rule, cutoff) from the mildest on, level by level.
PATH: list[tuple[str, float]] = [
    (rule, _levels(rule)[level])
    for level in range(max(len(grid) for _, _, grid in RULES.values()))
    for rule in RULES
    if level < len(RULES[rule][2])
]


def _first_step(rule: str) -> Column:
    """The first step of the path at which the rule rejects a row; null if none does."""
    metric, sign, _ = RULES[rule]
    out = F.lit(None).cast("int")
    for cutoff in reversed(_levels(rule)):  # the mildest one beyond which the metric lies
        out = F.when((F.col(metric) - F.lit(float(cutoff))) * sign > 0, PATH.index((rule, cutoff))).otherwise(out)
    return out


def _first_steps(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"step_{r}": _first_step(r) for r in RULES}).withColumn("step", F.least(*[f"step_{r}" for r in RULES]))


def last_steps(m: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Rows (stratum, step, n, k, p_value): the last safe step of each stratum that has one."""
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .where("quality = 1")
        .select(F.col("doc_id").alias("d"))
    )
    good = _ratios(m).where("NOT base_failed").join(marks, F.col("doc_id") == F.col("d"), "left_semi")
    never = F.lit(len(PATH))
    seen = _first_steps(good).groupBy(F.col("lang").alias("stratum"), F.coalesce("step", never).alias("first")).agg(
        F.count(F.lit(1)).alias("docs")
    )
    counts = (
        seen.withColumn("step", F.explode(F.sequence(F.lit(0), never - 1)))
        .groupBy("stratum", "step")
        .agg(F.sum("docs").alias("n"), F.sum(F.when(F.col("first") <= F.col("step"), F.col("docs")).otherwise(0)).cast("long").alias("k"))
    )
    # a stratum in which not even no rejection at all could be safe is not tested
    counts = staged(counts.where(F.col("n") * F.log1p(F.lit(-risk)) <= F.log(F.lit(delta))), "quality-counts")
    strata = max(1, counts.agg(F.count_distinct("stratum")).first()[0])
    # beyond the mean the tail exceeds one half: no need to sum it
    tail = F.when(F.col("k") <= F.col("n") * risk, binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    safe = counts.withColumn("p_value", tail).where(F.col("p_value") <= F.lit(delta / strata))
    # rejections only grow along the path, so the safe steps are its beginning
    best = F.max(F.struct("step", "n", "k", "p_value"))
    return safe.groupBy("stratum").agg(best.alias("b")).select("stratum", "b.*")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: the metrics, base_failed, kept and the learnt rules
    that reject it (``failed``, comma-joined)."""
    m = metrics(docs)
    last = staged(last_steps(m, labels).select("stratum", F.col("step").alias("last")), "quality-steps")
    rows = _first_steps(_ratios(m)).join(last, F.col("lang") == F.col("stratum"), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(f"step_{rule}") <= F.col("last"), F.lit(rule)) for rule in RULES]))
    return rows.withColumn("failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
        F.array_join("failed", ",").alias("failed"),
    )
