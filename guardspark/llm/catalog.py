"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.llm import op1_html, op10_decontaminate, op11_runs, op12_lines, op13_merkle, op2_toxicity, op3_neardup, op4_chat, op5_lattice, op6_quality, op7_secrets, op8_tokens, op9_mix, oracle
from guardspark.llm.common import crc_mod, table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_html.extracted(table(spark, sf_dir, "pages"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = op2_toxicity.fit(docs, table(spark, sf_dir, "labels"), learns=~held_out)
    return op2_toxicity.scored(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_passages",
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op4_chat.with_control(spark, table(spark, sf_dir, "conversations"))
    return op4_chat.digest(op4_chat.windows(rows))


def op5_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = op5_lattice.scored(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2, rounds=op5_lattice.ROUNDS)
    # the model's score is the one in which a training word is a piece as well
    base = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    return scores.select(*base, F.col("mixture_score").alias("score"), "mixture_score", F.col("score").alias("lattice_score"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed")


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secrets.report(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_tokens.tokenized(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mix.taken_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_decontaminate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op11_runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return op11_runs.digest(op11_runs.periodic_runs(docs))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_lines.digest(op12_lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_merkle.tamper_check(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_toxic_segments": op2_toxic_segments,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_chat_windows": op4_chat_windows,
    "op5_lattice_scores": op5_lattice_scores,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_links": op7_secret_links,
    "op8_token_files": op8_token_files,
    "op9_mix_sources": op9_mix_sources,
    "op10_decontaminate_benchmark": op10_decontaminate_benchmark,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = dict(oracle.ORACLE_SQL)
