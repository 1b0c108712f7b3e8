"""Token files against the tokenizer itself, and what the files hold."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from helpers import SF, awkward, docs_df
from pyspark.sql import functions as F

from guardspark.llm import op8_tokens as tk
from guardspark.llm.common import fresh_folder, small_batches


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tk.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [tk.END_ID] for x in texts]


def test_pieces_give_the_ids_of_the_whole_text():
    r = random.Random(3)
    parts = [" ", " ", "\n", "a", "it's", "<|endoftext|>", "é", "　", "12", "!!", "\t", "\x1c", "\x85", " \n", "漢字", "'ll"]
    parts += [".", "word.", "x,", "1.", "ß?", "'", ",'", "a'", "Ω!", "\xad", "\xa0", "\x1e", "\x1f", "\x00", "ſ", "ǆ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    enc = tk.PieceEncoder(tk.default_tokenizer(), tk.END_ID)
    assert enc.encode(pa.array(texts)).to_pylist() == whole(texts)
    assert enc.encode(pa.array(texts)).to_pylist() == whole(texts)  # now from the cache
    assert enc.encode(pa.array([], pa.string())).to_pylist() == []


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(5)
    parts = [" ", " ", "\n", "a", "It's", "Word", "é", "12", "!!", "  ", "漢字", "'ll", "x.", "x y"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(600)]
    own = json.loads(Tokenizer.from_file(tk.default_tokenizer()).to_str())
    cases = {"words": json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())}
    cases["prefixed"] = own | {"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}
    cases["whole"] = own | {"pre_tokenizer": own["pre_tokenizer"] | {"use_regex": False}}
    cases["lower"] = own | {"normalizer": {"type": "Lowercase"}}
    cases["added"] = own | {"added_tokens": [*own["added_tokens"], {"id": 50257, "content": "x y", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]}
    assert tk.cuts_at_white_space(Tokenizer.from_file(tk.default_tokenizer()))
    for name, spec in cases.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec))
        tok = Tokenizer.from_file(str(path))
        assert not tk.cuts_at_white_space(tok), name
        want = [tok.encode(t, add_special_tokens=False).ids + [9] for t in texts]
        assert tk.PieceEncoder(str(path), 9).encode(pa.array(texts)).to_pylist() == want, name


def test_cache_of_any_size_gives_the_same(monkeypatch):
    monkeypatch.setattr(tk, "CACHE_PIECES", 3)
    texts = ["the cat, the dog.", "a dog the cat\nthe end", "x" * 200 + " the"] * 3
    enc = tk.PieceEncoder(tk.default_tokenizer(), tk.END_ID)
    assert enc.encode(pa.array(texts)).to_pylist() == whole(texts)


def test_a_smaller_cache_is_kept_to_and_gives_the_same(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(3000)}x" for _ in range(200)) for _ in range(60)]
    enc = tk.PieceEncoder(tk.default_tokenizer(), tk.END_ID, 500)
    for t, want in zip(texts, whole(texts), strict=True):
        assert enc.encode(pa.array([t])).to_pylist() == [want]
        assert len(enc.known) <= 500 and len(enc.older) <= 500
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    assert digest(tk.tokenized(docs_df(spark, rows), pieces=500)) == expected([(i, t) for i, t, _ in rows])


def test_batches_of_long_texts_are_cut_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    with small_batches(spark, 5000, 1 << 20):
        got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 60 and len(got) > 1
    assert max(r["size"] for r in got) < 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def expected(rows):
    """Digest rows in ascending id order, from the tokenizer."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, out = 0, []
    for (i, *_), ids in zip(order, whole([t for _, t in order]), strict=True):
        out.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_shipped_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digest(tk.tokenized(docs)) == expected(rows)


def test_awkward_rows_and_empty_table(spark):
    rows = awkward()
    assert digest(tk.tokenized(docs_df(spark, rows).repartition(5))) == expected([(i, t) for i, t, _ in rows])
    assert digest(tk.tokenized(docs_df(spark, []))) == []


def test_files_are_selective(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = tk.write_tokens(docs, fresh_folder(spark, "format"))
    files = glob.glob(f"{path.removeprefix('file://')}/tokens/part-*.parquet")
    meta = [pq.ParquetFile(f).metadata for f in files]
    group = next(m.row_group(0) for m in meta if m.num_rows)
    by_name = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert "RLE_DICTIONARY" in by_name["ids"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in by_name.values())
    plan = tk.read_tokens(spark, path, 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "LessThanOrEqual(doc_id,9)" in plan
    assert sorted(r.doc_id for r in tk.read_tokens(spark, path, 5, 9).select("doc_id").collect()) == [5, 6, 7, 8, 9]
    index = tk.read_index(spark, path)
    assert "ids" not in index.columns and index.count() == docs.count()


def test_slices_are_large_enough_to_look_pieces_up_seldom(spark):
    # 12 MB of texts, 1,200 rows: three slices and a rest, six before
    texts = pa.array(["wörter " * 1250] * 1200)
    assert len(list(tk._slices(texts))) <= 4
    assert len(list(tk._slices(texts, 2 << 20))) >= 6
    rows = [(i, f"some {i} words of {i % 7}", "a") for i in range(60)]
    want = expected([(i, t) for i, t, _ in rows])
    assert digest(tk.tokenized(docs_df(spark, rows), slice_bytes=100)) == digest(tk.tokenized(docs_df(spark, rows))) == want


def test_a_piece_is_asked_for_once_in_each_cache():
    class Asked(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    enc = tk.PieceEncoder(tk.default_tokenizer(), tk.END_ID)
    enc.known, enc.older = Asked(), Asked()
    enc.encode(pa.array(["one two three"]))
    # three words and the end; twice for each word before
    assert (enc.known.asked, enc.older.asked) == (4, 3)
