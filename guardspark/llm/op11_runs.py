"""Operator 11: periodic runs of words, by Lyndon roots from Baier grouping.

A run is a maximal stretch of consecutive words with a smallest period.  By the
runs theorem each run holds a Lyndon root that is the longest Lyndon word at its
place under one of the two alphabet orders.  Phase one of Baier's suffix sorter
groups suffixes by exactly that word (``lyndon_array``): groups are taken from
the highest down, the nearest suffix to the left in a lower group takes the
group's word behind its own, and what a suffix has gathered when its group's
turn comes is its longest Lyndon word.  Run once under either order, the lengths
are the Lyndon arrays; equal lengths three times in a row mark candidate roots,
and common extensions to either side (``_extent``) turn a root into its run.

Only runs of at least ``MIN_EXPONENT`` periods and ``MIN_WORDS`` words count.  Every
five words in a row inside such a run occur in it again, so a text is first cut
into stretches whose five-word sequences all recur in the text (found by hash; a
hash clash only makes a stretch longer).  The cut is exact: each run lies in one stretch.

Scale: narrow, one pass over the texts, linear in a text's words but for one sort of
its five-word hashes; a Python worker holds a slice of few texts.  No shuffle, so
no key can be hot.  A text is one task's work.

Defined results: null, empty and blank texts have no words and no runs, their collapsed
text is ''; very long texts are searched whole; equal words tie by being the same
word (bytes); repeated rows and null ids are documents of their own; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import in_slices, words_col

MIN_EXPONENT = 4
MIN_WORDS = 6
#: Words of the sequences that must recur inside a run; at most ``MIN_WORDS`` - 1.
GRAM = 5

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by Baier grouping.

    ``symbols`` are ranks 0..k-1; a proper prefix is smaller.
    """
    n, k = len(symbols), max(symbols, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    group = list(symbols)
    length = [1] * k
    # the order of the groups; slot -1 (the last) closes both ends
    below = list(range(-1, k - 1))
    above = [*range(1, k), -1]
    # nearest[i]: a place at or left of i - 1 from which to look for a suffix not taken yet
    nearest = list(range(n + 1))
    out = [0] * n
    g = k - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = []
        u = length[g]
        for i in mine:
            nearest[i + 1] = i
            out[i] = u
        gathered: dict[int, int] = {}
        for i in mine:
            j = i
            while nearest[j] != j:
                nearest[j] = j = nearest[nearest[j]]
            nearest[i + 1] = j
            if j:
                gathered[j - 1] = gathered.get(j - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for i, times in gathered.items():
            moved.setdefault((times, group[i]), []).append(i)
        # more copies sort higher: placed first, so that fewer come between
        for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new = len(length)
            length.append(length[old] + times * u)
            members.append(moved[times, old])
            for i in moved[times, old]:
                group[i] = new
            after = above[old]
            below.append(old)
            above.append(after)
            above[old] = new
            if after >= 0:
                below[after] = new
        g = below[g]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two sequences share from their first on."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : at + step][: n - at] != b[at : at + step][: n - at]
        j = int(differ.argmax())
        if differ[j]:
            return at + j
        at, step = at + step, 2 * step
    return n


def _extent(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The stretch [start, end) around ``i`` whose words p apart are identical."""
    right = _common(w[i:], w[i + p :])
    left = _common(w[:i][::-1], w[: i + p][::-1])
    return i - left, i + p + right


def stretch_runs(w: np.ndarray, exponent: int = MIN_EXPONENT, least: int = MIN_WORDS) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch of word numbers."""
    _, ranks = np.unique(w, return_inverse=True)
    n, runs = len(w), set()
    for symbols in (ranks, ranks.max() - ranks):
        roots = np.asarray(lyndon_array(symbols.tolist()))
        at = np.arange(n)
        # a run of four periods holds its root three times in a row at least
        first = at[at + 3 * roots <= n]
        p = roots[first]
        first = first[(roots[first + p] == p) & (roots[first + 2 * p] == p)]
        seen: dict[int, int] = {}
        for i in first.tolist():
            p = int(roots[i])
            if i + p < seen.get(p, 0):
                continue  # inside the stretch just measured for this period
            start, end = _extent(w, i, p)
            seen[p] = end
            if end - start >= max(least, exponent * p):
                runs.add((start, end - start, p))
    return runs


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def text_runs(words: list) -> list[tuple[int, int, int]]:
    """Runs of a whole text, by start, then period."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    known: dict = {}
    w = np.fromiter((known.setdefault(x, len(known)) for x in words), dtype=np.uint64, count=n)
    if len(known) > n - 3:
        return []  # a run of four periods repeats three words at least
    m = n - GRAM + 1
    grams = np.zeros(m, dtype=np.uint64)
    for k in range(GRAM):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX[4] + w[k : k + m] * _MIX[k]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    starts = np.flatnonzero(np.isin(grams, twice))
    # stretches: recurring sequences that overlap or touch
    cuts = np.flatnonzero(np.diff(starts) > GRAM)
    out = []
    for a, b in zip(starts[np.r_[0, cuts + 1]].tolist(), (starts[np.r_[cuts, len(starts) - 1]] + GRAM).tolist(), strict=True):
        if b - a >= MIN_WORDS:
            out += [(a + s, length, p) for s, length, p in stretch_runs(w[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, p in runs:
        keep[start + p : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        runs, texts = [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode().split()
            found = text_runs(words)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(collapsed(words, found).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())],
            names=["doc_id", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, runs (by start, then period), collapsed text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, SCHEMA)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every document whose h = crc32(doc_id) is divisible by 10
    repeats words from word a on with period p, as the query's contract fixes:
    a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)), g = floor(h / 10).
    Null ids have no h and stay as they are."""
    words = words_col(F.col("text"))
    n = F.size(words).cast("long")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeats = F.ceil((n - a) / p).cast("int")
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, repeats)), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The longest run; ties by the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``periodic_runs``' rows."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return (
        found.withColumn("best", _best(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("best.start")).alias("start"),
            F.col("best.length").alias("length"),
            (-F.col("best.period")).alias("period"),
            F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
            F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
