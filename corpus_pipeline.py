"""Training-data corpus pipeline: stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and reread as the next
stage's documents.  All but the last return the columns of ``documents``; the last
returns the digest of the token files it writes (doc_id, start, n_tokens,
ids_crc32), one row per document of the mix.

In every stage an empty table gives an empty table, other columns pass through whatever their names, and very long
texts are taken whole; each stage's docstring says what becomes of nulls, empty texts, repeated rows and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.llm import op2_toxicity, op3_neardup, op8_tokens, op9_mix, op10_decontaminate
from guardspark.llm.common import crc_mod, staged, table


#: Pieces a worker's token cache keeps here, where the executors still hold what the stages before took.
TOKEN_PIECES = 100_000
#: And the text it encodes at a time.
TOKEN_SLICE_BYTES = 2 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.  Null and empty texts have no evidence and the
    score of none; repeated rows go or stay together; a score of one half goes; rows with a null id are scored, never learnt from."""
    learns = crc_mod(F.col("doc_id"), 5) != 0
    return op2_toxicity.accepted(docs, op2_toxicity.fit(docs, table(spark, sf_dir, "labels"), learns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.  Null and empty texts are
    in no group and stay; rows without an id stay; rows that agree in id and text count as one; of
    rows with one id and other texts in a group, the smallest text hash stays."""
    return op3_neardup.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty texts hold none; rows that agree in id and text, null
    ids among them, go or stay together; a similarity of exactly the threshold goes."""
    return op10_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it, in the order of the mix's slots.  Documents without a word
    (null and empty texts) are taken 0 times; a null source is a source of its own; repeated rows are
    documents of their own; equal hashes are ordered by id, size and row."""
    return op9_mix.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and their digest read back.  A null text is its end id alone; null ids come
    first; rows of one id are ordered by their text hash."""
    return op8_tokens.tokenized(docs, pieces=TOKEN_PIECES, slice_bytes=TOKEN_SLICE_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("drop_toxic", drop_toxic),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("write_token_files", write_token_files),
]

#: A learnt toxicity score and a BPE tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's rows are written to
    the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
