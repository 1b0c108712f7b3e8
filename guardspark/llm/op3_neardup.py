"""Operator 3: near-duplicates by a signature-coordinate inverted join.

Two documents are linked when the sets of their 5-word shingles have
``100 * intersection >= 85 * union``.

1. One Arrow pass takes every whole text to its shingle set, a 128-bit
   fingerprint of the set and a MinHash signature.  Rows with the same
   fingerprint (equal sets) are one *class*; only its smallest document goes on.
2. Every coordinate-value pair of a signature is a token, and documents are
   posted under their tokens.  Tokens are ordered by document frequency.  Two
   signatures that agree in at least ``MIN_MATCHES`` of ``COORDS`` places must
   share a token among the ``COORDS - MIN_MATCHES + 1`` rarest of each
   (prefix), so only those are posted; long lists (a passage that a third of
   all documents share) fall outside the prefix and are skipped.
3. Candidates come from the postings in two steps.  *Stars*: the most central
   document of each posting meets the others, which links a large group of
   near copies in as many pairs as it has members.  *Rest*: documents outside
   the largest component of a posting meet every posted document of another
   component, at the first token they share, if sizes allow.  The size test
   uses the shingles that occur in no other posted document: they cannot be in
   an intersection, so of two near copies with many own words neither is
   compared with the other.  Both tests are exact: no cap, no sampling.
4. A candidate pair is kept if its full signatures agree in ``MIN_MATCHES``
   places, and becomes a link only if the full shingle sets meet the threshold.
5. Components of the links by repeated contraction to the smallest neighbour
   in a random order, each round written to the shared folder.

A pair at similarity 0.85 exactly agrees in 54.4 of 64 places on average, with
a standard deviation of 2.9: fewer than 40 has a probability near 1e-6.

Hot groups: all copies of a text share a fingerprint, so components are joined to the classes, one row each, and only
then to the documents; that join and the one by component have one row per key on their other side, and Spark splits their skewed partitions.

Defined results: null and blank texts have the empty set (``n_shingles`` 0) and
are linked with nothing; fewer than five words make one shingle; a row without
doc_id is linked with nothing, has a null component and is kept; repeated rows
are each returned; rows with one doc_id and other texts are nodes of their own,
and ``kept`` compares ids; very long texts are shingled whole; other columns are ignored (``deduplicated`` keeps
all); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import free_names, in_slices, staged

WORDS = 5
#: Link when PERCENT_NUM * intersection >= PERCENT_DEN * union.
SIM_PERCENT = 85
COORDS = 64
MIN_MATCHES = 40
PREFIX = COORDS - MIN_MATCHES + 1
#: Hash buckets of a set's counts, for the bound on intersections.
BUCKETS = 64
#: Star rounds before the rest is compared.
STARS = 2
#: Words of the bitmap of posted ids (64 bits each, some 10 MB in an executor at most); a power of two.
BITMAP_WORDS = 1 << 18
#: Rounds in which the components must be complete; each leaves a constant fraction of the nodes.
ROUNDS = 200

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_A = _odd(COORDS, 11)
_B = _odd(COORDS, 12)
_TAG = np.arange(COORDS, dtype=np.uint64) << np.uint64(58)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the text, A-Z lower-cased."""
    import xxhash

    # bytes.split() splits at exactly the characters 09-0D and 20
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, len(w) if len(w) < WORDS else WORDS, dtype=np.uint64)
    for k in range(min(WORDS, len(w))):
        h = _mix(h * _MULT + w[k : k + n])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """Tokens: the coordinate in the top 6 bits, the coordinate's minimum below."""
    out = np.full(COORDS, ~np.uint64(0))
    for at in range(0, len(s), 4096):  # long documents in blocks
        out = np.minimum(out, ((s[at : at + 4096, None] * _A + _B) ^ (s[at : at + 4096, None] >> np.uint64(29))).min(axis=0))
    return (_TAG | (out >> np.uint64(6))).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return tuple(np.frombuffer(d, dtype="<i8").tolist())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in in_slices(batches):
            sizes, f1, f2, sigs = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t)
                a, c = fingerprint(s)
                sizes.append(len(s))
                f1.append(a)
                f2.append(c)
                sigs.append(signature(s) if len(s) else np.empty(0, np.int64))
            off = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("uid"),
                    b.column("doc_id"),
                    b.column("h"),
                    pa.array(sizes, pa.int64()),
                    pa.array(f1, pa.int64()),
                    pa.array(f2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))),
                ],
                names=["uid", "doc_id", "h", "n", "f1", "f2", "tokens"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in in_slices(batches):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            fp = [fingerprint(s) for s in sets]
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in fp], pa.int64()),
                    pa.array([x[1] for x in fp], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64))),
                    pa.array(
                        [np.bincount((x % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) for x in sets],
                        pa.list_(pa.int64()),
                    ),
                ],
                names=["f1", "f2", "shingles", "buckets"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Staged rows (uid, doc_id, h, n, f1, f2, tokens) of all documents; h is
    a hash of the text that tells rows of one id apart."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("h"),
        "text",
    )
    schema = "uid long, doc_id long, h long, n long, f1 long, f2 long, tokens array<long>"
    return staged(numbered.mapInArrow(_signatures, schema), "nd-signatures")


def classes(sig: DataFrame) -> DataFrame:
    """Rows (f1, f2, node): documents with equal, non-empty sets; the node is
    the row id of one of them."""
    return (
        sig.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("f1", "f2")
        .agg(F.min("uid").alias("node"))
    )


def prefixes(sig: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (node, doc_id, f1, f2, n, tokens, prefix, centrality) of the
    representatives that post a shared token: ``prefix`` holds the shared
    tokens among their ``PREFIX`` rarest, rarest first."""
    one = sig.join(reps.select(F.col("node").alias("uid")), "uid", "left_semi").withColumnRenamed("uid", "node")
    posted = one.select("node", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = (
        posted.join(shared, "token")
        .groupBy("node")
        .agg(
            F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df"),  # at most COORDS
            F.sum(F.log("df")).alias("centrality"),
        )
        # tokens of no other document come first in the order and fill the prefix
        .withColumn("room", F.lit(PREFIX - COORDS) + F.size("by_df"))
        .where("room > 0")
        .select("node", "centrality", F.expr("transform(slice(by_df, 1, room), x -> x.token)").alias("prefix"))
    )
    return one.join(own, "node")


def _can_link(n_a: Column, s_a: Column, n_b: Column, s_b: Column) -> Column:
    """Whether sets of n_a and n_b shingles, of which s_a and s_b occur in
    another posted document at all, can reach the threshold."""
    most = F.least(s_a, s_b)
    return most * 100 >= (n_a + n_b - most) * SIM_PERCENT


def verified(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose signatures agree in at least
    MIN_MATCHES places and whose full shingle sets meet the threshold."""
    a = active.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), F.col("shingles").alias("sa"))
    b = active.select(F.col("node").alias("b"), F.col("tokens").alias("tb"), F.col("shingles").alias("sb"))
    both = (
        pairs.join(a, "a")
        .join(b, "b")
        .where(F.size(F.array_intersect("ta", "tb")) >= MIN_MATCHES)
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    )
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * SIM_PERCENT).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp): connected components of edges (a, b).

    Each round gives every node the smallest node of its neighbourhood in a
    random order and contracts the graph; what is left shrinks by a constant
    factor a round.  Assignments are composed as the rounds go on.
    """
    left = staged(edges.where("a <> b").distinct(), "nd-edges")
    total = None
    step = 0
    while not left.isEmpty():
        if step == ROUNDS:
            raise RuntimeError(f"components are not complete after {ROUNDS} rounds")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("v"))
        sides = left.select(F.col("a").alias("u"), order("b").alias("w")).unionByName(
            left.select(F.col("b").alias("u"), order("a").alias("w"))
        )
        to = staged(
            sides.groupBy("u")
            .agg(F.min("w").alias("w"))
            .select("u", F.least(F.col("w"), order("u")).getField("v").alias("c")),
            "nd-round",
        )
        if total is None:
            total = to.select(F.col("u").alias("node"), F.col("c").alias("comp"))
        else:
            total = staged(
                total.join(to, total["comp"] == to["u"], "left").select(
                    "node", F.coalesce("c", "comp").alias("comp")
                ),
                "nd-comps",
            )
        left = staged(
            left.join(to.select(F.col("u").alias("a"), F.col("c").alias("ca")), "a")
            .join(to.select(F.col("u").alias("b"), F.col("c").alias("cb")), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            .where("a <> b")
            .distinct(),
            "nd-edges",
        )
        step += 1
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    return total


def _with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds ``comp``; a node without links is its own."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    named = comps.select("node", F.col("comp").alias("__c"))
    return rows.join(named, "node", "left").withColumn("comp", F.coalesce("__c", "node")).drop("__c")


def _open_postings(active: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Postings (token, node, comp, centrality, n, s) of tokens under which
    more than one component is posted, with the token's largest component."""
    rows = _with_comp(active.select("node", "centrality", "n", "s", "prefix"), comps)
    post = rows.select("node", "comp", "centrality", "n", "s", F.explode("prefix").alias("token"))
    per = (
        post.groupBy("token", "comp")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("members", "comp")).getField("comp").alias("big"))
        .where("comps > 1")
        .select("token", "big")
    )
    return staged(post.join(per, "token"), "nd-postings")


def star_pairs(post: DataFrame, first: bool) -> DataFrame:
    """The most central document of each posting (in later rounds: outside
    the posting's largest component) with the posting's other components."""
    pool = post if first else post.where("comp <> big")
    pivot = pool.groupBy("token").agg(F.max(F.struct("centrality", "node", "comp", "n", "s")).alias("p"))
    return (
        post.join(pivot, "token")
        .where((F.col("comp") != F.col("p.comp")) & _can_link(F.col("n"), F.col("s"), F.col("p.n"), F.col("p.s")))
        .select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
        .distinct()
    )


def rest_pairs(post: DataFrame, active: DataFrame) -> DataFrame:
    """Every pair of different components that share a posting, at the first
    token of their prefixes they share, if the bounds allow; one side lies
    outside the token's largest component, which covers each such pair."""
    post = post.join(active.select("node", "prefix", "shared"), "node")
    # n of a partner lies in [least, most]: from the similarity and from s
    least = F.ceil(F.col("n") * SIM_PERCENT / 100.0 - 1e-6)
    most = F.least(
        F.floor(F.col("n") * 100.0 / SIM_PERCENT + 1e-6),
        F.floor(F.col("s") * (100.0 + SIM_PERCENT) / SIM_PERCENT - F.col("n") + 1e-6),
    )
    size_class = lambda c: F.floor(F.log(c) * F.lit(6.0))  # noqa: E731  two or three meet a document
    probe = (
        post.where("comp <> big")
        .withColumn("least", least)
        .withColumn("most", most)
        .where("least <= most")
        .withColumn("cls", F.explode(F.sequence(size_class("least"), size_class("most"))))
    )
    probe = probe.select("token", "cls", F.col("node").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"), F.col("s").alias("su"), F.col("prefix").alias("pu"), F.col("shared").alias("bu"))
    base = post.select("token", size_class("n").alias("cls"), F.col("node").alias("v"), F.col("comp").alias("cv"), F.col("n").alias("nv"), F.col("s").alias("sv"), F.col("prefix").alias("pv"), F.col("shared").alias("bv"), (F.col("comp") != F.col("big")).alias("outside"))
    most_common = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
    on = (
        (probe["token"] == base["token"])
        & (probe["cls"] == base["cls"])
        & (F.col("cu") != F.col("cv"))
        # a pair outside the largest component on both sides is met twice: once is enough
        & (~F.col("outside") | (F.col("u") < F.col("v")))
        & _can_link(F.col("nu"), F.col("su"), F.col("nv"), F.col("sv"))
        & (F.element_at(F.array_intersect("pu", "pv"), 1) == probe["token"])
        & (most_common * 100 >= (F.col("nu") + F.col("nv") - most_common) * SIM_PERCENT)
    )
    return (
        probe.join(base, on)
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .distinct()
    )


def _perhaps_posted(texts: DataFrame, posted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id is in a bitmap of the posted ids: all posted ones, and others by chance,
    more of them the more ids are posted (a tenth with 1.7 million)."""
    x = F.xxhash64("doc_id")
    word = F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).alias("__word")
    bit = F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")
    bits = posted.select(word, bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    return (
        texts.withColumn("__word", word)
        .join(F.broadcast(bits), "__word")  # BITMAP_WORDS rows at most, whatever the input
        .where(F.getbit("__bits", x.bitwiseAND(F.lit(63)).cast("int")) == 1)
        .select(texts.columns)
    )


def posted_texts(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of the posted ids.  The bitmap leaves most other texts where they are read, so these are not shuffled
    (a semi-join would be moved below it, and shuffle them all)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _perhaps_posted(texts, posted).join(posted.select("doc_id").distinct(), "doc_id")


def links(docs: DataFrame, sig: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between class nodes that suffice for all components."""
    posted = staged(prefixes(sig, reps), "nd-prefixes")
    # full sets of the posting documents only, from their whole texts
    texts = posted_texts(docs, posted)
    sets = texts.select("text").mapInArrow(_sets, "f1 long, f2 long, shingles array<long>, buckets array<long>").dropDuplicates(["f1", "f2"])
    held = staged(posted.join(sets, ["f1", "f2"]), "nd-sets")
    bucket = F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    own = (
        held.select("node", F.explode("shingles").alias("x"))
        .groupBy("x")
        .agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("df"))
        .where("df = 1")
        .groupBy("node", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("node")
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("own"))  # at most BUCKETS
    )
    less = F.transform("buckets", lambda x, i: x - F.coalesce(F.col("own")[i], F.lit(0)))
    shared = F.when(F.col("own").isNull(), F.col("buckets")).otherwise(less)
    active = held.join(own, "node", "left").withColumn("shared", shared).drop("own", "buckets")
    active = staged(
        active.withColumn("s", F.aggregate("shared", F.lit(0).cast("long"), lambda t, x: t + x)), "nd-active"
    )
    found, comps = None, None
    for step in range(STARS + 1):
        post = _open_postings(active, comps)
        pairs = rest_pairs(post, active) if step == STARS else star_pairs(post, step == 0)
        new = staged(verified(pairs, active), "nd-links")
        found = new if found is None else found.unionByName(new)
        if step < STARS:
            comps = components(found)
    return found


def membership(docs: DataFrame) -> DataFrame:
    """Per document row: uid, doc_id, h, n, comp (null: linked with nothing)."""
    sig = signatures(docs)
    reps = staged(classes(sig), "nd-classes")
    comps = components(links(docs, sig, reps))
    named = _with_comp(reps.select("f1", "f2", "node"), comps).select("f1", "f2", "comp")
    member = sig.select("uid", "doc_id", "h", "n", "f1", "f2").join(named, ["f1", "f2"], "left").withColumn(
        # empty sets and rows without an id are linked with nothing
        "comp", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("comp"))
    )
    return member.select("uid", "doc_id", "h", "n", "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    member = membership(docs)
    least = member.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id")
    return (
        member.join(least, "comp", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component left: that of the smallest
    doc_id (of rows with that id, the smallest text hash).  Rows that repeat
    both id and text count as one; rows without an id stay."""
    member = staged(membership(docs), "nd-member")
    alone = member.where("comp IS NULL AND doc_id IS NOT NULL").select("doc_id", "h")
    heads = (
        member.where("comp IS NOT NULL")
        .groupBy("comp")
        .agg(F.min(F.struct("doc_id", "h")).alias("head"))
        .select("head.doc_id", "head.h")
    )
    i, h = free_names(docs, "__id", "__hash")
    keep = alone.unionByName(heads).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    rows = docs.where("doc_id IS NOT NULL").withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    return (
        rows.join(keep, [i, h], "left_semi")
        .dropDuplicates([i, h])
        .select(*docs.columns)
        .unionByName(docs.where("doc_id IS NULL"))
    )
