"""Operator 2: toxicity by maximum-scoring segments.

Model, learnt from labelled documents:

* *Token scores.*  A token is a word of letters and digits in lower case.  Its
  score is the log-odds of its rate in toxic and in clean documents, both under
  a Dirichlet prior.  The prior is itself a posterior: the leanings of the other
  word forms of the token's ``STEM``-letter stem (under a flat prior), so an
  unseen form of a toxic stem is scored, and a rare word of no toxic stem stays
  near zero.
  Counts are of documents, not occurrences, so one long text cannot carry a
  word.  Tokens and stems whose log-odds are below ``MIN_ODDS`` or not clearly
  positive (``Z_MIN`` standard deviations) score ``-DRIFT``.
* *Segments.*  Over the scores of a text, one scan finds all maximal scoring
  segments (Ruzzo and Tompa); words between two scoring words cost DRIFT each,
  so a scan over the scoring words alone is enough.  Its work is linear.
* *Calibration.*  The best score of a random text of n words follows an
  extreme-value law: P(best >= S) = 1 - exp(-K n exp(-lambda (S - MIN_ODDS))).
  lambda and K are fitted on clean labelled documents; a segment is significant when its
  probability is below ``ALPHA``.  The surprise -log P of the significant
  segments is summed, and a logistic curve, fitted on the labelled rows, takes
  that sum to a score in 0..1.

Labels are read only where ``learns`` (in the query: crc32(doc_id) mod 5 is not
0).  Score inputs are the text alone.

Scale: the model is fitted on at most ``MAX_LABELLED`` labelled rows of either
class, chosen by a hash of the id: a bounded sample, whose words bound the tables that go to the
executors; every token and stem that passes the tests is kept.  Scoring is one pass without a shuffle over all whole texts.

Defined results: null and empty texts have no segment and get the curve's
value at 0; very long texts are scanned whole, in linear time; repeated rows are scored each, equal scores are all kept; without any labelled row of one of the
classes every score is 0; other columns pass through ``accepted`` and are ignored elsewhere; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import in_slices, staged

STEM = 4
#: Shortest word that has a stem.
STEM_FROM = 5
Z_MIN = 3.0
STEM_Z_MIN = 2.0
#: Least log-odds of a scoring token or stem: words merely frequent in a toxic
#: document's language or topic stay at -DRIFT.
MIN_ODDS = 2.0
#: Prior strength of a stem's rates for its tokens, and of the flat prior.
STEM_STRENGTH = 4.0
FLAT_STRENGTH = 1.0
DRIFT = 0.5
MAX_SCORE = 12.0
ALPHA = 0.005
MAX_LABELLED = 20_000
#: Parts that the words of one stem are spread over.
STEM_PARTS = 8
_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Model:
    tokens: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-3
    slope: float = 0.0
    bias: float = -40.0

    def hits(self, text: str | None) -> tuple[list[tuple[int, float, int, int]], int]:
        """Scoring words (ordinal, score, start, end) and the number of words."""
        out: list[tuple[int, float, int, int]] = []
        n = 0
        tokens, stems = self.tokens, self.stems
        for n, m in enumerate(_TOKEN.finditer((text or "").lower()), 1):
            w = m.group()
            s = tokens.get(w)
            if s is None and len(w) >= STEM_FROM:
                s = stems.get(w[:STEM])
            if s is not None:
                out.append((n - 1, s, m.start(), m.end()))
        return out, n

    def p_value(self, score: float, n: int) -> float:
        """P(a clean text of n words has a segment of at least this score)."""
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.lam * (score - MIN_ODDS)))

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant segments (start, end, score, p) in code points of the
        lower-cased text."""
        hits, n = self.hits(text)
        found = []
        for i, j, s in segments([(at, sc) for at, sc, _, _ in hits], DRIFT):
            p = self.p_value(s, n)
            if p < ALPHA:
                found.append((hits[i][2], hits[j][3], s, p))
        return found

    def evidence(self, text: str | None) -> float:
        return sum(-math.log(max(p, 1e-300)) for *_, p in self.passages(text))

    def score(self, evidence: float) -> float:
        x = self.slope * math.log1p(evidence) + self.bias
        return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which position ``at``
    scores ``s`` for each hit (at, s) and every other position ``-drift``.

    Returns (first hit, last hit, score).  Ruzzo and Tompa's candidates, with the
    run of misses before each hit taken as one step.  Each candidate keeps the place of
    the nearest one before it that starts lower, and the search for a lower start goes along these links,
    so none is passed twice; where no lower start is left, all candidates are final.
    """
    final: list[list] = []
    stack: list[list] = []  # [first, last, left sum, right sum, place of the nearest lower start]
    total, last_at = 0.0, -1
    for i, (at, s) in enumerate(hits):
        total -= drift * (at - last_at - 1)
        last_at = at
        left, total = total, total + s
        if s <= 0:
            continue
        first, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0:
                final += stack
                stack = []
                break
            if stack[j][3] >= total:
                break
            first, left, lower = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = lower
        stack.append([first, i, left, total, j])
    return [(a, b, right - left) for a, b, left, right, _ in final + stack]


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): documents of the batch that hold the word."""
    from collections import Counter

    for b in batches:
        toxic, clean = Counter(), Counter()
        for t, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(set(_TOKEN.findall((t or "").lower())))
        words = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.string()),
                pa.array([toxic[w] for w in words], pa.int64()),
                pa.array([clean[w] for w in words], pa.int64()),
            ],
            names=["word", "toxic", "clean"],
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, learns: Column, bound: int) -> DataFrame:
    """At most about ``bound`` rows (text, toxic) of each class, by a hash of
    the id: a thinning per class whose rate follows from the class counts."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)"
    ).where(learns).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    point = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, bound / max(n.get(1, 0), bound)).otherwise(bound / max(n.get(0, 0), bound))
    # about 2 * bound rows of (id, label) whatever the size of the input: small enough to broadcast
    chosen = F.broadcast(marks.where(point < rate))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")


def _fit_tables(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Positive token and stem scores, from the documents that hold each word."""
    nt, nc = float(n_toxic), float(n_clean)
    share = nt / (nt + nc)
    flat_t, flat_c = F.lit(FLAT_STRENGTH * share), F.lit(FLAT_STRENGTH * (1 - share))
    rate_t, rate_c = F.col("toxic") / F.lit(nt), F.col("clean") / F.lit(nc)
    words = counts.withColumn("lean", rate_t / (rate_t + rate_c)).withColumn(
        "stem", F.when(F.length("word") >= STEM_FROM, F.substring("word", 1, STEM))
    )
    # a stem counts its word forms, each by its lean, not their documents: one
    # frequent toxic word does not make its clean neighbours toxic
    stems = (
        words.where("stem IS NOT NULL")
        .groupBy("stem")
        .agg(F.sum("lean").alias("st"), F.sum(1 - F.col("lean")).alias("sc"))
    )
    yt, yc = F.col("st") + flat_t, F.col("sc") + flat_c
    odds = F.log(yt) - F.log(yc)
    stems = stems.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / yt + 1 / yc))
    # a word's prior: the other forms of its stem, with the strength of a few documents
    toxic = words.where("toxic > 0")
    part = F.pmod(F.xxhash64("word"), F.lit(STEM_PARTS)).cast("int")
    spread = stems.select("stem", "st", "sc", F.explode(F.array(*[F.lit(i) for i in range(STEM_PARTS)])).alias("part"))
    stemmed = toxic.where("stem IS NOT NULL").withColumn("part", part).join(spread, ["stem", "part"]).drop("part")
    # short words have no stem and meet nothing
    words = stemmed.unionByName(toxic.where("stem IS NULL"), allowMissingColumns=True)
    own = F.col("st").isNotNull()
    rest_t = F.when(own, F.greatest(F.col("st") - F.col("lean"), F.lit(0.0))).otherwise(0.0) + flat_t
    rest_c = F.when(own, F.greatest(F.col("sc") - 1 + F.col("lean"), F.lit(0.0))).otherwise(0.0) + flat_c
    strength = F.least(F.lit(STEM_STRENGTH), rest_t + rest_c) / (rest_t + rest_c)
    yt, yc = F.col("toxic") + strength * rest_t, F.col("clean") + strength * rest_c
    odds = F.log(yt / (F.lit(nt + 1) - F.col("toxic"))) - F.log(yc / (F.lit(nc + 1) - F.col("clean")))
    words = words.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / yt + 1 / yc))

    def scoring(df: DataFrame, key: str, z_min: float) -> dict[str, float]:
        # words of a bounded sample
        clear = df.where((F.col("z") >= z_min) & (F.col("odds") >= MIN_ODDS))
        return {r[0]: min(float(r[1]), MAX_SCORE) for r in clear.select(key, "odds").collect()}

    return scoring(words, "word", Z_MIN), scoring(stems, "stem", STEM_Z_MIN)


def _sample_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            best, n = [], []
            for t in b.column("text").to_pylist():
                hits, words = model.hits(t)
                best.append(max((s for *_, s in segments([(a, s) for a, s, _, _ in hits], DRIFT)), default=0.0))
                n.append(words)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(best), pa.array(n, pa.int64())], names=["toxic", "best", "words"])

    return run


def _sample_evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([model.evidence(t) for t in b.column("text").to_pylist()], pa.float64())],
                names=["toxic", "evidence"],
            )

    return run


def fit_extreme_value(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of P(best >= S) = 1 - exp(-K n exp(-lambda (S - MIN_ODDS)))
    from clean texts.  No segment scores less than MIN_ODDS, so the chance of
    any, 1 - exp(-K n), gives K; the excess over MIN_ODDS is exponential with
    rate lambda.  One prior event keeps both finite where clean texts hardly
    score."""
    hit = best > 0
    excess = np.maximum(best[hit] - MIN_ODDS, 0.0)
    lam = float(np.clip((len(excess) + 1.0) / (excess.sum() + 1.0), 0.3, 3.0))
    return lam, float((len(excess) + 1.0) / (np.maximum(words, 1).sum() + 1.0))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of P(y=1 | x), by Newton steps with a slight penalty on
    the slope; the two classes count by their own numbers."""
    w = np.array([1.0, -1.0])
    X = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + ridge, X.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learns: Column | None = None, bound: int = MAX_LABELLED) -> Model:
    """Model from the labelled rows for which ``learns`` holds."""
    sample = staged(labelled_sample(docs, labels, F.lit(True) if learns is None else learns, bound), "tox-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    counts = staged(
        # copies of one text count once
        sample.select("text", "toxic")
        .dropDuplicates()
        .mapInArrow(_word_batches, "word string, toxic long, clean long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "tox-counts",
    )
    tokens, stems = _fit_tables(counts, n[1], n[0])
    model = Model(tokens, stems)
    got = sample.select("text", "toxic").mapInArrow(_sample_scores(model), "toxic int, best double, words long").toPandas()
    clean = got[got.toxic == 0]
    model.lam, model.k = fit_extreme_value(clean.best.to_numpy(), clean.words.to_numpy())
    ev = sample.select("text", "toxic").mapInArrow(_sample_evidence(model), "toxic int, evidence double").toPandas()
    model.slope, model.bias = fit_logistic(np.log1p(ev.evidence.to_numpy()), ev.toxic.to_numpy().astype(float))
    return model


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            found = [model.passages(t) for t in b.column("text").to_pylist()]
            ev = [sum(-math.log(max(x[3], 1e-300)) for x in f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([model.score(e) for e in ev], pa.float64()), pa.array([len(f) for f in found], pa.int32())],
                names=["doc_id", "score", "n_passages"],
            )

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document row: doc_id, score, n_passages."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_score_batches(model), "doc_id long, score double, n_passages int")


def _accept_batches(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            mask = [model.score(model.evidence(t)) < 0.5 for t in b.column(text_at).to_pylist()]
            yield b.filter(pa.array(mask))

    return run


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    return docs.mapInArrow(_accept_batches(model, docs.columns.index("text")), docs.schema)
