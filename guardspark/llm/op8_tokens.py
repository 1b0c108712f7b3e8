"""Operator 8: token ids as Parquet list columns.

File format (one folder):

* ``tokens/``  one row per document in ascending doc_id order: ``part`` (file
  ordinal), ``row`` (ordinal in the file), ``doc_id``, ``n_tokens``, ``ids``
  (list of int, end id included).  ``ids`` is dictionary encoded (at most one
  entry per vocabulary id and row group); ``part``, ``row``, ``doc_id`` and
  ``n_tokens`` are delta encoded (format v2, no dictionary).  Row groups and
  pages have fixed sizes and every column has a page index, so a reader that
  asks for a doc_id range or for the metadata alone reads only those pages.
* ``index/``   the same rows without ids plus ``start``, the number of ids
  before the document in the whole corpus.

Scale: one range shuffle of the texts by (doc_id, text hash), so repeated ids
split too; encoding streams Arrow batches; the corpus-wide offsets come from
per-file totals (one row per file).  A lost executor repeats its own tasks:
files are committed by Spark's writer.

Texts whose white space is single spaces and newlines between other characters
are cut before each space and around each newline.  The byte-level
pre-tokenizer always starts a token there, so encoding the pieces one by one
gives the ids of the whole text; each distinct piece of a batch is encoded once,
or comes from the worker's bounded cache.  Other texts are encoded in one call, and so are all texts
where the tokenizer file is not of that kind (``cuts_at_white_space``).

Defined results: null text is the empty text (its ids are the end id alone);
null doc_id sorts first; repeated rows are separate documents, in the order of
their text hash; very long texts are encoded whole; extra columns are ignored; empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardspark.llm.common import fresh_folder, small_batches

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 5000
#: Pieces kept by one Python worker (twice; some 400 bytes each), and the longest piece worth keeping.
CACHE_PIECES = 420_000
CACHE_CHARS = 48
#: Text encoded at a time by one Python worker: each distinct piece is looked up once a slice, so larger slices take
#: less time and more memory (33 MB of texts: 12.0 s at 2 MB, 9.6 s at 4 MB, with 71 MB more a worker).
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch while tokens are written, and its bytes: some slices' worth, however long the texts are.
ARROW_ROWS = 5000
ARROW_BYTES = 8 << 20

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#part": "false",
    "parquet.enable.dictionary#row": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#start": "false",
}

TOKEN_SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in kept}
    out |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return out


#: White space other than single spaces and newlines between other characters
#: (the white space of either regex dialect, U+001C..U+001F with it).
_UNEVEN = (
    "[\\t\\x0b\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    "|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
)


def cuts_at_white_space(tokenizer) -> bool:
    """Whether texts may be encoded piece by piece: a byte-level BPE whose regex starts a token at each single
    space and newline, with no normalizer, no randomness, no affixes, and no added token that holds or takes in white space."""
    spec = json.loads(tokenizer.to_str())
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "ignore_merges")
    )
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]))
        for t in spec.get("added_tokens", [])
    )
    return bool(byte_level and plain and added and spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding"))


class PieceEncoder:
    """Ids of whole texts, through cached pieces."""

    def __init__(self, path: str, end_id: int, pieces: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_piece = cuts_at_white_space(self.tokenizer)
        self.end = array("I", [end_id]).tobytes()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        # two generations: a full one becomes the older, pieces met again move up
        self.pieces = CACHE_PIECES if pieces is None else pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece: a word, with a space before it or not, or a newline."""
        got = self.known.get(piece)
        return self._not_known(piece) if got is None else got

    def _not_known(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            word = piece.rstrip(string.punctuation)
            bare = piece[1:] if piece[:1] == " " else piece
            if len(word) < len(piece) and word[-1:].isalnum() and not any(x in piece for x in self.added):
                # a run of marks that ends the piece after a letter or digit is a token of its own
                got = self.piece(word) + self.piece(piece[len(word) :])
            elif bare.isalpha() and (piece.isascii() or max(bare) < "\u0250"):
                # letters alone (after at most one space) are one word of the model
                spelt = piece.replace(" ", self.space) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                got = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            else:
                got = self.whole(piece) if piece else b""
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= self.pieces:
                self.older, self.known = self.known, {"\x1e": self.end}
            self.known[piece] = got
        return got

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text, the end id after each."""
        if not self.by_piece:
            blobs = [self.whole(t) + self.end for t in texts.to_pylist()]
            return _lists(b"".join(blobs), np.asarray([len(b) // 4 for b in blobs], dtype=np.int64))
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        # pieces are parted by U+001F, and the end stands as U+001E: even texts have neither
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x1f "), "\n", "\x1f\n\x1f")
        cut = pc.if_else(uneven, "\x1e", pc.binary_join_element_wise(cut, "\x1e", "\x1f"))
        parts = pc.split_pattern(cut, "\x1f")
        pieces = parts.flatten().dictionary_encode()
        self.known["\x1e"] = self.end
        known = self.known.get
        ids = [known(w) or self._not_known(w) for w in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        at = pieces.indices.to_numpy()
        lists = _lists(b"".join(ids), sizes)
        flat = lists.take(pieces.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        if pc.any(uneven).as_py():
            # such texts are encoded in one call each
            blobs = [
                self.whole(t) + self.end if odd else flat[i:j].tobytes()
                for t, odd, i, j in zip(texts.to_pylist(), uneven.to_pylist(), ends[:-1], ends[1:], strict=True)
            ]
            return _lists(b"".join(blobs), np.asarray([len(b) // 4 for b in blobs], dtype=np.int64))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _lists(blob: bytes, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(blob, dtype="<i4")))


_encoders: dict[tuple[str, int, int | None], PieceEncoder] = {}


def encoder(path: str, end_id: int, pieces: int | None = None) -> PieceEncoder:
    """One tokenizer and piece cache per worker process."""
    key = (path, end_id, pieces)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def _slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs (start, rows) of at most about ``size`` (SLICE_BYTES) bytes of text, a row at least."""
    size = size or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield at, to - at
        at = to


def _encode_batches(path: str, end_id: int, pieces: int | None = None, slice_bytes: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, row = encoder(path, end_id, pieces), 0
        for batch in batches:
            for at, n in _slices(batch.column("text"), slice_bytes):
                piece = batch.slice(at, n)
                ids = enc.encode(pc.fill_null(piece.column("text"), ""))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, dtype=np.int32)),
                        pa.array(np.arange(row, row + n, dtype=np.int64)),
                        piece.column("doc_id").cast(pa.int64()),
                        pc.list_value_length(ids).cast(pa.int64()),
                        ids,
                    ],
                    names=["part", "row", "doc_id", "n_tokens", "ids"],
                )
                row += n
            pa.default_memory_pool().release_unused()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, pieces: int | None = None,
    slice_bytes: int | None = None,
) -> str:
    """Encode ``docs`` (doc_id, text) into the format above; returns ``path``.  ``pieces``, ``slice_bytes``: a worker's
    cache and the text it encodes at a time, where ``CACHE_PIECES`` and ``SLICE_BYTES`` are too much memory; the files do
    not depend on them."""
    spark = docs.sparkSession
    run = _encode_batches(tokenizer or default_tokenizer(), end_id, pieces, slice_bytes)
    encoded = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("h"))
        .select("doc_id", "text")
        .mapInArrow(run, TOKEN_SCHEMA)
    )
    with small_batches(spark, ARROW_ROWS, ARROW_BYTES):
        encoded.write.options(**FORMAT).parquet(f"{path}/tokens")
    meta = spark.read.schema(TOKEN_SCHEMA).parquet(f"{path}/tokens").drop("ids")
    per_part = meta.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    (
        meta.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "part")
        .select("part", "row", "doc_id", "n_tokens", (F.col("offset") + F.col("inner")).alias("start"))
        .sortWithinPartitions("part", "row")
        .write.options(**FORMAT)
        .parquet(f"{path}/index")
    )
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Metadata alone: (part, row, doc_id, n_tokens, start)."""
    return spark.read.schema("part int, row long, doc_id long, n_tokens long, start long").parquet(f"{path}/index")


def read_tokens(
    spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None
) -> DataFrame:
    """Token rows of a doc_id range (both ends included); the bounds reach the
    scan and select row groups and pages."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(f"{path}/tokens")
    if first_doc is not None:
        df = df.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        df = df.where(F.col("doc_id") <= last_doc)
    return df


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        at = ids.offsets.to_numpy()
        values = ids.values.to_numpy()  # little-endian 32-bit words, as the digest wants them
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), b.column("row"), b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["part", "row", "doc_id", "n_tokens", "ids_crc32"],
        )


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    crcs = read_tokens(spark, path).mapInArrow(
        _crc_batches, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"
    )
    starts = read_index(spark, path).select("part", "row", "start")
    return crcs.join(starts, ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenized(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, pieces: int | None = None,
    slice_bytes: int | None = None,
) -> DataFrame:
    """Write the files into a fresh shared folder and return their digest."""
    path = write_tokens(docs, fresh_folder(docs.sparkSession, "tokens"), tokenizer, end_id, pieces, slice_bytes)
    return file_digest(docs.sparkSession, path)
