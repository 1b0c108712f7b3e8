r"""Operator 5: language-model scoring by a subword lattice.

The pieces of an existing subword vocabulary (a file; never trained here), weighted by the vocabulary's own scores, form
a unigram model over the words of a text.  A word, with its leading word mark,
can be cut into pieces in many ways; its probability is the sum over all cuts of
the product of the piece probabilities, found by a forward recursion in log space.
Every character can also be spelt by the vocabulary's byte pieces, so no word is
impossible.  A text is its words followed by one end event, whose probability the training documents give:

    log10 P(text) = sum over words of log10((1 - P(end)) * P(word)) + log10 P(end).

That is ``score``.  The shipped vocabulary scores a piece by its rank alone, so its probability is taken as
1 / (rank + 100), normalised.

``mixture_score`` is the same with each word's probability mixed with its share of the training occurrences, by Witten and
Bell's rule (C occurrences, T distinct words):

    C / (C + T) * c / C  +  T / (C + T) * P(word).

With ``rounds`` the weights of the pieces are learnt as well, starting from the vocabulary's own: a round sums, over distinct
training words, how often each piece is expected in a word's cuts (forward and backward sums), and the weights follow those
sums, smoothed by ``PRIOR`` pieces dealt by the vocabulary's weights.  The pieces themselves stay.  Distinct words, not
occurrences, since what is spelt are the words that training did not see.  All distinct training words teach the weights.

Base figures: each token (a word, and the end) has log10((c + 1) / (N + V + 1)),
with c its count, N all and V the distinct tokens of the training documents.

Scale: words are counted per batch before the shuffle; the lattice runs once per
distinct word (and once more per round), not per occurrence, over thousands of words at a time (``Arcs``).  Words that make up at least one in
``HEAD`` of all tokens (at most ``HEAD`` of them by that definition) are
summed where the documents are read; the others, none of which can be hot,
are joined with the word table.  One row per document is staged between the
passes, so repeated ids stay apart and a lost executor repeats little.

Defined results: null and empty texts are the end alone (n_tokens 1); a null
doc_id has the id text ''; repeated rows are scored each (and counted each in
training); without training documents N = 0 and V = 0; very long texts are scored whole, very long words too; ties do not
occur (no ranking); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import in_slices, staged

MARK = "▁"
RANK_SHIFT = 100.0
HEAD = 100_000
#: Rounds in which the query learns the weights of the pieces.
ROUNDS = 2
#: Pieces that the vocabulary's own weights count for beside the learnt ones.
PRIOR = 1000.0
#: Distinct words a worker counts before it hands them on.
FLUSH = 300_000
#: Characters whose lattices are built together, about; words beyond ``LONG`` characters go one by one.
TOGETHER = 150_000
LONG = 256
#: More than any character; no piece goes on by it.
_STOP = (1 << 21) - 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[bytes]:
    # bytes.split() splits at exactly the characters 09-0D and 20
    return (text or "").encode().lower().split()


@dataclass
class Lattice:
    """Natural-log piece probabilities and the recursion over them."""

    pieces: dict[str, float] = field(default_factory=dict)
    byte_pieces: list[float] = field(default_factory=lambda: [-20.0] * 256)
    longest: int = 1
    #: Training occurrences, distinct training words and training documents.
    occurrences: int = 0
    distinct: int = 0
    ends: int = 0
    _begins: dict[str, float] | None = None
    #: Characters spelt by byte pieces, as they are met.
    _spelt: dict[str, float] = field(default_factory=dict)
    _trie: Trie | None = None

    @property
    def end(self) -> float:
        """log10 P(end)."""
        return math.log10((self.ends + 1) / (self.occurrences + self.ends + 2))

    @property
    def word(self) -> float:
        """log10 of the probability that a word comes."""
        return math.log10((self.occurrences + 1) / (self.occurrences + self.ends + 2))

    def log10_mixture(self, spelt: float, c: int) -> float:
        """log10 of a word's mixture, from log10 P(word) and its c training occurrences."""
        if not self.occurrences:
            return spelt
        both = self.occurrences + self.distinct
        spelt += math.log10(self.distinct / both)
        if not c:
            return spelt
        seen = math.log10(c / both)
        top = max(seen, spelt)
        return top + math.log10(10 ** (seen - top) + 10 ** (spelt - top))

    def _table(self) -> dict[str, float]:
        """Log probabilities of pieces; minus infinity for what only begins one."""
        if self._begins is None:
            begins = {p[:n]: -math.inf for p in self.pieces for n in range(1, len(p))}
            self._begins = begins | self.pieces
        return self._begins

    def log10_word(self, word: str) -> float:
        """log10 of the sum over all cuts of the marked word.

        forward[i] is the log of the sum over the cuts of the first i characters."""
        s = MARK + word
        get, n, longest, spelt = self._table().get, len(s), self.longest, self._spelt
        incoming: list[list[float]] = [[] for _ in range(n + 1)]
        incoming[0].append(0.0)
        for at in range(n):
            x = _log_sum(incoming[at])
            c = s[at]
            p = spelt.get(c)
            if p is None:
                p = spelt[c] = sum(self.byte_pieces[b] for b in c.encode())
            incoming[at + 1].append(x + p)
            for to in range(at + 1, min(n, at + longest) + 1):
                p = get(s[at:to])
                if p is None:
                    break  # no piece begins so
                if p > -math.inf:
                    incoming[to].append(x + p)
        return _log_sum(incoming[n]) / math.log(10)

    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.pieces)
        return self._trie

    def log10_words(self, words: list[str]) -> list[float]:
        """``log10_word`` of each word."""
        out = [self.log10_word(w) if len(w) > LONG else 0.0 for w in words]
        for group in _groups(words):
            for i, x in zip(group, (Arcs(self, [words[i] for i in group]).totals() / math.log(10)).tolist(), strict=True):
                out[i] = x
        return out

    def expect_all(self, words: list[str], into: Counter[str]) -> None:
        """``expect`` of each word."""
        for w in words:
            if len(w) > LONG:
                self.expect(w, into)
        sums = np.zeros(len(self.pieces))
        for group in _groups(words):
            pieces, spelt = Arcs(self, [words[i] for i in group]).expected()
            sums += pieces
            for c, n in spelt.items():
                for b in c.encode():
                    into[_byte_name(b)] += n
        for piece, n in zip(self.pieces, sums.tolist(), strict=True):
            if n:
                into[piece] += n

    def expect(self, word: str, into: Counter[str]) -> None:
        """Add how often each piece (a byte piece by its name) is expected in the cuts of the marked word."""
        s = MARK + word
        get, n, longest = self._table().get, len(s), self.longest
        incoming: list[list[float]] = [[] for _ in range(n + 1)]
        incoming[0].append(0.0)
        forward, arcs = [], []
        for at in range(n):
            x = _log_sum(incoming[at])
            forward.append(x)
            spelt = sum(self.byte_pieces[b] for b in s[at].encode())
            incoming[at + 1].append(x + spelt)
            mine = [(at + 1, spelt, None)]
            for to in range(at + 1, min(n, at + longest) + 1):
                piece = s[at:to]
                p = get(piece)
                if p is None:
                    break
                if p > -math.inf:
                    incoming[to].append(x + p)
                    mine.append((to, p, piece))
            arcs.append(mine)
        total = _log_sum(incoming[n])
        backward = [0.0] * (n + 1)
        for at in range(n - 1, -1, -1):
            backward[at] = _log_sum([p + backward[to] for to, p, _ in arcs[at]])
            x = forward[at] - total
            for to, p, piece in arcs[at]:
                share = math.exp(x + p + backward[to])
                if piece is not None:
                    into[piece] += share
                else:
                    for b in s[at].encode():
                        into[_byte_name(b)] += share

    def refitted(self, expected: dict[str, float], prior: Lattice) -> Lattice:
        """The same pieces weighted by their expected counts beside ``PRIOR`` pieces of ``prior``."""
        total = math.log(sum(expected.values()) + PRIOR)

        def weight(name: str, p: float) -> float:
            return math.log(expected.get(name, 0.0) + PRIOR * math.exp(p)) - total

        pieces = {piece: weight(piece, p) for piece, p in prior.pieces.items()}
        spelt = [weight(_byte_name(b), p) for b, p in enumerate(prior.byte_pieces)]
        return Lattice(pieces, spelt, self.longest, self.occurrences, self.distinct, self.ends)


def _byte_name(b: int) -> str:
    return f"<0x{b:02X}>"


class Trie:
    """Pieces by their beginnings.  Node 0 is the empty one, ``keys[i]`` the parent and the last character of node i + 1."""

    def __init__(self, pieces: dict[str, float]):
        begins = sorted(sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}), key=len)
        node = {b: i for i, b in enumerate(begins, 1)} | {"": 0}
        # ascending, as the beginnings are sorted by length first
        self.keys = np.array([node[b[:-1]] << 21 | ord(b[-1]) for b in begins] + [np.iinfo(np.int64).max], np.int64)
        #: The number of the piece that a node is, or -1; the log probabilities by that number.
        self.piece = np.full(len(node), -1, np.int64)
        self.piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        self.p = np.array(list(pieces.values()), float)


def _groups(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words up to ``LONG``, longest first, in groups of about ``TOGETHER`` characters."""
    group, n = [], 0
    for i in sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: -len(words[i])):
        group.append(i)
        n += len(words[i]) + 2
        if n > TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


class Arcs:
    """The lattices of many words, longest first, and the two recursions over them, a place after the other.

    Place d of word w is number ``first[d] + w``, so a place of all words is one stretch; every arc goes to a later place."""

    def __init__(self, lattice: Lattice, words: list[str]):
        trie = lattice.trie()
        lens = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(lens + 1) - lens - 1
        chars = np.frombuffer("".join([f"{MARK}{w} " for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
        chars[begin + lens] = _STOP
        word = np.repeat(np.arange(len(words)), lens + 1)
        place = np.arange(len(chars)) - begin[word]
        #: Words that have place d, and the number of its first.
        self.have = np.bincount(place)
        self.first = np.concatenate([[0], np.cumsum(self.have)])
        self.last = self.first[lens] + np.arange(len(words))
        number = self.first[place] + word
        self.word = np.empty_like(number)
        self.word[number] = word
        at = np.flatnonzero(chars != _STOP)
        self.letters, self.letter = np.unique(chars[at], return_inverse=True)
        spelt = np.array([sum(lattice.byte_pieces[b] for b in chr(c).encode()) for c in self.letters.tolist()], float)
        # arcs that spell a character first, then those of pieces
        starts, ends, names, ps = [number[at]], [number[at + 1]], [], [spelt[self.letter]]
        node, n = np.zeros(len(at), np.int64), 0
        while len(at):
            keys = node << 21 | chars[at + n]
            found = np.searchsorted(trie.keys, keys)
            goes = trie.keys[found] == keys
            at, node, n = at[goes], found[goes] + 1, n + 1
            name = trie.piece[node]
            ends_here = name >= 0
            names.append(name[ends_here])
            ps.append(trie.p[names[-1]])
            starts.append(number[at[ends_here]])
            ends.append(number[at[ends_here] + n])
        self.pieces = len(trie.p)
        self.start, self.end, self.name, self.p = (np.concatenate(x) for x in (starts, ends, names, ps))

    def _sums(self, of: np.ndarray, onto: np.ndarray, places: Iterator[int]) -> np.ndarray:
        """For each number of ``onto`` the log of the sum over its arcs, place by place, from 0 where no arc comes."""
        order = np.argsort(onto, kind="stable")
        of, onto, p = of[order], onto[order], self.p[order]
        cuts = np.searchsorted(onto, self.first)
        out = np.zeros(self.first[-1])
        for d in places:
            mine = slice(cuts[d], cuts[d + 1])
            to = onto[mine]
            terms = out[of[mine]] + p[mine]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            # the words that go on at a place are its first
            top = np.maximum.reduceat(terms, heads)
            out[to[heads]] = top + np.log(np.add.reduceat(np.exp(terms - top[to - self.first[d]]), heads))
        return out

    def forward(self) -> np.ndarray:
        return self._sums(self.start, self.end, range(1, len(self.have)))

    def totals(self) -> np.ndarray:
        """The natural log of each word's probability."""
        return self.forward()[self.last]

    def expected(self) -> tuple[np.ndarray, dict[str, float]]:
        """How often each piece, and each character spelt, is expected in the cuts of all words."""
        forward, backward = self.forward(), self._sums(self.end, self.start, range(len(self.have) - 2, -1, -1))
        total = forward[self.last]
        share = np.exp(forward[self.start] + self.p + backward[self.end] - total[self.word[self.start]])
        n = len(self.letter)
        spelt = np.bincount(self.letter, share[:n], len(self.letters))
        return np.bincount(self.name, share[n:], self.pieces), dict(zip(map(chr, self.letters.tolist()), spelt.tolist(), strict=True))


def _log_sum(terms: list[float]) -> float:
    """log of the sum of exp(term)."""
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


def vocabulary(path: str) -> tuple[list[str], list[float], list[int]]:
    """(pieces, prior probabilities, kinds): kind -1 for a normal piece, the
    byte for a byte piece, -2 for one that no text contains."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights, kinds = [], [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        pieces.append(piece)
        if sp.is_byte(i):
            kinds.append(int(piece[3:5], 16))
            weights.append(1.0 / (sp.get_piece_size() + RANK_SHIFT))
        elif sp.is_control(i) or sp.is_unknown(i):
            kinds.append(-2)
            weights.append(0.0)
        else:
            kinds.append(-1)
            # a merge vocabulary scores a piece by minus its rank
            weights.append(1.0 / (abs(sp.get_score(i)) + RANK_SHIFT))
    total = sum(weights)
    return pieces, [w / total for w in weights], kinds


def make_lattice(path: str, occurrences: int = 0, distinct: int = 0, ends: int = 0) -> Lattice:
    pieces, weights, kinds = vocabulary(path)
    out = Lattice(occurrences=occurrences, distinct=distinct, ends=ends)
    for piece, p, kind in zip(pieces, weights, kinds, strict=True):
        if kind == -2:
            continue
        if kind >= 0:
            out.byte_pieces[kind] = math.log(p)
        else:
            out.pieces[piece] = math.log(p)
            out.longest = max(out.longest, len(piece))
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c, f): occurrences in training documents and in all."""

    def out() -> pa.RecordBatch:
        words = [w.decode() for w in every]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([train[w] for w in every], pa.int64()), pa.array(every.values(), pa.int64())],
            names=["word", "c", "f"],
        )

    train: Counter[bytes] = Counter()
    every: Counter[bytes] = Counter()
    for b in in_slices(batches):
        for text, held in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
            words = words_of(text)
            every.update(words)
            if not held:
                train.update(words)
            if len(every) > FLUSH:
                yield out()
                train.clear()
                every.clear()
    yield out()


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Staged rows (word, c, f) over the whole texts of all documents."""
    return staged(
        docs.select("text", held_out.alias("held_out"))
        .mapInArrow(_count_batches, "word string, c long, f long")
        .groupBy("word")
        .agg(F.sum("c").alias("c"), F.sum("f").alias("f")),
        "lm-words",
    )


def _expected_batches(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: Counter[str] = Counter()
        for b in batches:
            lattice.expect_all(b.column("word").to_pylist(), into)
        yield pa.RecordBatch.from_arrays([pa.array(into.keys(), pa.string()), pa.array(into.values(), pa.float64())], names=["piece", "n"])

    return run


def fitted(counts: DataFrame, prior: Lattice, rounds: int) -> Lattice:
    """The lattice after ``rounds`` of expected counts over all distinct training words of ``counts``; what
    comes to the driver is one number a piece of the vocabulary."""
    words = counts.where("c > 0").select("word")
    lattice = prior
    for _ in range(rounds if prior.distinct else 0):
        sums = words.mapInArrow(_expected_batches(lattice), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        # rounded: the sums' last digits depend on the order of the tasks
        lattice = lattice.refitted({r["piece"]: round(r["n"], 6) for r in sums.toLocalIterator()}, prior)
    return lattice


def _word_batches(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spelt = lattice.log10_words(b.column("word").to_pylist())
            mixed = [lattice.log10_mixture(p, c) + lattice.word for p, c in zip(spelt, b.column("c").to_pylist(), strict=True)]
            lp = pa.array([p + lattice.word for p in spelt], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("c"), b.column("f"), lp, pa.array(mixed, pa.float64())], names=["word", "c", "f", "lp", "mp"]
            )

    return run


def _doc_batches(head: dict[bytes, tuple[float, float, float, bool]]):
    """Sums over head words, and the other words with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            n, known, base, score, mixture, words, times, cuts = [], [], [], [], [], [], [], [0]
            for text in b.column("text").to_pylist():
                tf = Counter(words_of(text))
                k, s, p, m = 0, 0.0, 0.0, 0.0
                for w, t in tf.items():
                    got = head.get(w)
                    if got is None:
                        words.append(w.decode())
                        times.append(t)
                    else:
                        s += t * got[0]
                        p += t * got[1]
                        m += t * got[2]
                        k += t if got[3] else 0
                n.append(sum(tf.values()))
                known.append(k)
                base.append(s)
                score.append(p)
                mixture.append(m)
                cuts.append(len(words))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("uid"), b.column("doc_id"), b.column("held_out"),
                    pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(mixture, pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["uid", "doc_id", "held_out", "n", "known", "base", "score", "mixture", "words", "times"],
            )

    return run


def scored(docs: DataFrame, held_out: Column, path: str | None = None, head: int = HEAD, rounds: int = 0) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, mixture_score; learnt from the rows where ``held_out`` is false.
    Without ``rounds`` the pieces keep the vocabulary's own weights."""
    path = path or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = word_counts(docs, held_out)
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("f"), F.lit(0)).alias("f"), F.count_if(F.col("c") > 0).alias("v")
    ).first()
    ends = docs.where(~held_out).count()
    n_all, distinct = total["c"] + ends, total["v"] + (1 if ends else 0)
    lattice = fitted(counts, make_lattice(path, total["c"], total["v"], ends), rounds)
    table = staged(counts.mapInArrow(_word_batches(lattice), "word string, c long, f long, lp double, mp double"), "lm-lattice")
    frequent = table.where(F.col("f") * head >= total["f"])  # at most `head` rows
    known = {r["word"].encode(): (math.log10(r["c"] + 1), r["lp"], r["mp"], r["c"] > 0) for r in frequent.toLocalIterator()}
    per_doc = staged(
        docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held_out.alias("held_out"), "text").mapInArrow(
            _doc_batches(known),
            "uid long, doc_id long, held_out boolean, n long, known long, base double, score double, mixture double,"
            " words array<string>, times array<long>",
        ),
        "lm-documents",
    )
    rare = (
        per_doc.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w"))
        .select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("t"))
        .join(table.where(F.col("f") * head < total["f"]).select("word", "c", "lp", "mp"), "word")
        .groupBy("uid")
        .agg(
            F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("rare_base"),
            F.sum(F.col("t") * F.col("lp")).alias("rare_score"),
            F.sum(F.col("t") * F.col("mp")).alias("rare_mixture"),
            F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("rare_known"),
        )
    )
    zero = F.lit(0.0)
    n_tokens = F.col("n") + 1
    return (
        per_doc.drop("words", "times")
        .join(rare, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            n_tokens.alias("n_tokens"),
            (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (
                F.col("base") + F.coalesce("rare_base", zero) + F.lit(math.log10(ends + 1))
                - n_tokens * F.lit(math.log10(n_all + distinct + 1))
            ).alias("base_score"),
            (F.col("score") + F.coalesce("rare_score", zero) + F.lit(lattice.end)).alias("score"),
            (F.col("mixture") + F.coalesce("rare_mixture", zero) + F.lit(lattice.end)).alias("mixture_score"),
        )
    )
