"""Operator 12: reversible line dedup with sharded cuckoo filters.

A line's key is the line without the white space at its ends, A-Z lower-cased.  The
index of a corpus has one shard per range of key fingerprints (128 bits).  A
shard holds an exact table of reference counts (key, documents that hold it) and a cuckoo filter
of the keys found in ``min_docs`` documents or more.  ``inserted`` and
``deleted`` add and take away whole documents: the counts change, keys that pass
the bound on the way up enter the filter and those that fall below it leave it, so
deleting what was inserted gives the index of before and lines dropped meanwhile
come back.  ``deduplicated`` asks the filters for each distinct line of a document;
what a filter lets through is confirmed in the exact table, so a false hit drops nothing.

Scale: lines become narrow rows (document, first line with the key, key), one per distinct key
of a document, staged once; counts are aggregated before the shuffle.  The shards grow in number with
the keys, so a task holds at most about ``SHARD_KEYS`` counts.  Keys that make up a
``HEAVY``-th of all rows (at most ``HEAVY`` keys, by definition) are decided by a broadcast
of just those; all others are asked for by shard, split further where documents
are many (``PROBE_ROWS``).  Texts are shuffled once, by row number.  Intermediate tables lie in the shared
folder; a lost executor repeats its own tasks.

Defined results: null and empty texts are one empty line; lines shorter than ``min_chars`` code points
after stripping (with 1: blank ones) always stay; very long texts are split whole; repeated rows and null ids are
documents of their own; the columns of the documents come back with the text replaced (null stays null);
an empty table gives no rows.  Deleting a document that was never inserted raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardspark.llm.common import WS_CHARS, free_names, in_slices, staged

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of a shard, about; rows of one probe of a shard, about; heavy keys at most.
SHARD_KEYS = 1 << 16
PROBE_ROWS = 1 << 19
HEAVY = 10_000

SLOTS = 4
#: Filters are made for this share of their slots, and grow when an insertion finds no place.
LOAD = 0.8
KICKS = 500

INDEX_SCHEMA = "shard int, key binary, n_docs long, filter binary"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WS = WS_CHARS.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_WS).translate(_LOWER)


def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets of keys (rows of 16 bytes)."""
    words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    mark = ((words[:, 1] & np.uint64(0xFFFF)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
    first = words[:, 0] & np.uint64(buckets - 1)
    return mark, first.astype(np.int64), (first ^ _step(mark, buckets)).astype(np.int64)


def _step(mark: np.ndarray, buckets: int) -> np.ndarray:
    return (mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)) & np.uint64(buckets - 1)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds all ``keys``: larger ones are tried until they fit."""
        out = cls.sized(len(keys))
        while not out.insert(keys):
            out = cls(np.zeros((2 * len(out.table), SLOTS), dtype=np.uint16))
        return out

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, dtype="<u2").reshape(-1, SLOTS).copy())

    def blob(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _put(self, mark: int, first: int, second: int) -> bool:
        table = self.table
        for at in (first, second):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return True
        at, path = second, []
        for kick in range(KICKS):
            slot = (kick + mark) % SLOTS
            path.append((at, slot, int(table[at, slot])))
            mark, table[at, slot] = int(table[at, slot]), mark
            at ^= int(_step(np.asarray([mark], dtype=np.uint16), len(table))[0])
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return True
        for at, slot, old in reversed(path):  # as it was before
            table[at, slot] = old
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys; false where one finds no place."""
        places = _places(keys, len(self.table))
        return all(self._put(*p) for p in zip(*(x.tolist() for x in places), strict=True))

    def delete(self, keys: np.ndarray) -> None:
        """Take away one fingerprint of each key; all must have been inserted."""
        for mark, first, second in zip(*(x.tolist() for x in _places(keys, len(self.table))), strict=True):
            for at in (first, second):
                there = np.flatnonzero(self.table[at] == mark)
                if len(there):
                    self.table[at, there[0]] = 0
                    break
            else:
                raise ValueError("a key to be deleted is not in the filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = _places(keys, len(self.table))
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)


def _rows16(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of 16-byte values as rows of bytes."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.binary())
    return np.frombuffer(b"".join(flat.to_pylist()), dtype=np.uint8).reshape(-1, 16)


def _keys_of(text: str | None, least: int) -> dict[bytes, int]:
    """Each key of at least ``least`` code points with the first line that has it."""
    out: dict[bytes, int] = {}
    for i, line in enumerate((text or "").encode().split(b"\n")):
        key = line_key(line)
        if key not in out and (len(key) >= 4 * least or len(key.decode()) >= least):
            out[key] = i
    return out


def _pair_batches(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows, lines, keys = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _keys_of(text, least)
                rows += [row] * len(found)
                lines += found.values()
                keys += [hashlib.md5(k, usedforsecurity=False).digest() for k in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(lines, pa.int32()), pa.array(keys, pa.binary())], names=["row", "line", "key"]
            )

    return run


def line_pairs(docs: DataFrame, row: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Staged rows (row, line, key): each distinct key of a document, once."""
    found = docs.select(F.col(row).alias("row"), "text").mapInArrow(_pair_batches(min_chars), "row long, line int, key binary")
    return staged(found, "line-keys")


@dataclass(frozen=True)
class LineIndex:
    """Shards of (key, n_docs) rows, and one row (filter) each, key null."""

    rows: DataFrame
    shards: int = 1
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        return cls(spark.createDataFrame([], INDEX_SCHEMA), 1, min_docs, min_chars)

    def counts(self) -> DataFrame:
        return self.rows.where("key IS NOT NULL").select("shard", "key", "n_docs")

    def filters(self) -> DataFrame:
        return self.rows.where("filter IS NOT NULL").select("shard", "filter")

    def save(self, path: str) -> None:
        """Write the index; ``load`` reads it in a later job."""
        self.rows.write.partitionBy("shard").parquet(f"{path}/rows")
        meta = [(self.shards, self.min_docs, self.min_chars)]
        self.rows.sparkSession.createDataFrame(meta, "shards int, min_docs int, min_chars int").write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/rows"), meta.shards, meta.min_docs, meta.min_chars)


def _shard(key: str, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _merged(min_docs: int) -> Callable:
    """One shard: old counts and filter with the changes added."""

    def run(old: pa.Table, change: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else change).column("shard")[0].as_py()
        held = old.filter(pc.is_valid(old.column("key")))
        blobs = old.filter(pc.is_valid(old.column("filter"))).column("filter").to_pylist()
        zeros = lambda n: pa.array(np.zeros(n, dtype=np.int64))
        both = pa.concat_tables(
            [
                pa.table({"key": held.column("key"), "old": held.column("n_docs"), "change": zeros(held.num_rows)}),
                pa.table({"key": change.column("key"), "old": zeros(change.num_rows), "change": change.column("change")}),
            ]
        )
        both = both.group_by("key").aggregate([("old", "sum"), ("change", "sum")]).sort_by("key")
        before = both.column("old_sum").to_numpy()
        after = before + both.column("change_sum").to_numpy()
        if (after < 0).any():
            raise ValueError("a document to be deleted was never inserted")
        keys = _rows16(both.column("key"))
        up, down = (before < min_docs) & (after >= min_docs), (before >= min_docs) & (after < min_docs)
        found = CuckooFilter.read(blobs[0]) if blobs else None
        if found is not None:
            found.delete(keys[down])
        if found is None or not found.insert(keys[up]):
            found = CuckooFilter.of(keys[after >= min_docs])
        left = both.column("key").filter(pa.array(after > 0)).combine_chunks()
        n = len(left)
        return pa.table(
            {
                "shard": pa.array([shard] * (n + 1), pa.int32()),
                "key": pa.chunked_array([left, pa.array([None], pa.binary())], pa.binary()),
                "n_docs": pa.array([*after[after > 0].tolist(), None], pa.int64()),
                "filter": pa.array([None] * n + [found.blob()], pa.binary()),
            }
        )

    return run


def _updated(index: LineIndex, pairs: DataFrame, sign: int) -> LineIndex:
    change = staged(pairs.groupBy("key").agg((F.count(F.lit(1)) * sign).alias("change")), "line-changes")
    old = index.rows
    shards = index.shards
    keys = change.count() + index.counts().count()
    while shards * SHARD_KEYS < keys:
        shards *= 2
    if shards != index.shards:
        # keys move to finer shards; the filters are made anew from the exact counts
        old = index.counts().select(_shard("key", shards).alias("shard"), "key", "n_docs", F.lit(None).cast("binary").alias("filter"))
    merged = (
        old.groupBy("shard")
        .cogroup(change.withColumn("shard", _shard("key", shards)).groupBy("shard"))
        .applyInArrow(_merged(index.min_docs), INDEX_SCHEMA)
    )
    return LineIndex(staged(merged, "line-index"), shards, index.min_docs, index.min_chars)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    (row,) = free_names(docs, "__row")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def inserted(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with every row of ``docs`` added as a document."""
    held, row = _numbered(docs)
    return _updated(index, line_pairs(held, row, index.min_chars), 1)


def deleted(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without the documents ``docs``, which must have been inserted."""
    held, row = _numbered(docs)
    return _updated(index, line_pairs(held, row, index.min_chars), -1)


def _probed(pairs: pa.Table, filters: pa.Table) -> pa.Table:
    """The rows of one shard that its filter lets through."""
    out = pairs.select(["row", "line", "key"])
    if not filters.num_rows or not pairs.num_rows:
        return out.slice(0, 0)
    found = CuckooFilter.read(filters.column("filter")[0].as_py())
    return out.filter(pa.array(found.contains(_rows16(pairs.column("key")))))


def common_lines(index: LineIndex, pairs: DataFrame) -> DataFrame:
    """(row, lines): for each document the first lines of the keys that
    ``min_docs`` documents of the index hold, where there are any."""
    counts = index.counts()
    n = pairs.count()
    total = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    # each is in a HEAVY-th of all (document, key) pairs, so there are HEAVY of them at most
    heavy = F.broadcast(counts.where(F.col("n_docs") * HEAVY >= max(total, 1)).select("key", "n_docs"))
    marked = pairs.join(heavy, "key", "left")
    parts = max(1, -(-n // (index.shards * PROBE_ROWS)))
    rest = marked.where("n_docs IS NULL").select(
        _shard("key", index.shards).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "row", "line", "key"
    )
    filters = index.filters().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    passed = (
        rest.groupBy("shard", "part")
        .cogroup(filters.groupBy("shard", "part"))
        .applyInArrow(_probed, "row long, line int, key binary")
    )
    exact = passed.join(counts.where(F.col("n_docs") >= index.min_docs).select("key"), "key").select("row", "line")
    sure = marked.where(F.col("n_docs") >= index.min_docs).select("row", "line")
    return exact.unionByName(sure).groupBy("row").agg(F.collect_list("line").alias("lines"))


def _kept_batches(text_at: int, lines_at: int, n_lines_name: str, n_dropped_name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, firsts in zip(batch.column(text_at).to_pylist(), batch.column(lines_at).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if firsts:
                    common = {line_key(lines[i]) for i in firsts}
                    kept = [x for x in lines if line_key(x) not in common]
                texts.append(None if text is None else b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [c for i, c in enumerate(batch.columns) if i != lines_at]
            names = [c for i, c in enumerate(batch.schema.names) if i != lines_at]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, n_lines_name, n_dropped_name]
            )

    return run


def deduplicated(docs: DataFrame, index: LineIndex | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the common lines dropped from ``text``, and the columns n_lines (before)
    and n_dropped behind them (named with underscores where a column has the name).  Without an index the documents themselves are
    inserted into an empty one."""
    numbered, row = _numbered(docs)
    held = staged(numbered, "line-docs")
    pairs = line_pairs(held, row, min_chars if index is None else index.min_chars)
    if index is None:
        index = _updated(LineIndex.empty(docs.sparkSession, min_docs, min_chars), pairs, 1)
    (lines,) = free_names(held, "__lines")
    # hashed: the line numbers of a partition's documents are few beside their texts, which then need no sort
    common = common_lines(index, pairs).select(F.col("row").alias(row), F.col("lines").alias(lines)).hint("shuffle_hash")
    joined = held.join(common, row, "left").select(*docs.columns, lines)
    n_lines, n_dropped = free_names(docs, "n_lines", "n_dropped")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return joined.mapInArrow(_kept_batches(docs.columns.index("text"), len(docs.columns), n_lines, n_dropped), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``deduplicated``'s rows, staged: the texts pass in small batches."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return staged(docs.select("doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256")), "line-digest")
