"""Requests from JSON lines (A1, A2): broken lines are kept and told apart.

Each line is parsed once, as a VARIANT.  Fields of the request body have the types of
the contract: ``input_text`` a string, ``context`` an object, ``process_with_llm`` a
boolean (or one of the words and numbers that stand for one), ``output_schema`` an object or null.  A line that is no JSON, no object, or has
a field of another type gets a ``reader_error`` and no text; nothing is dropped and nothing becomes a row of nulls.

``context`` and ``output_schema`` stay untyped (VARIANT); ``contract`` makes the output contract's typed
columns of the schema.  A schema whose type is a list or an object cannot be looked up: such
a request gets ``output_error``, and its output validator fails closed (E3), as it does for ``required`` that is not a list of strings.

The same columns come from a batch and from a stream of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts and numbers that stand for a boolean.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]

#: Error of a type that cannot be looked up, and of required keys that cannot be.
TYPE_ERROR = "TypeError"


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("__v"), f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, VOID (a JSON null), BIGINT and so on; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _of_kind(kind: Column, *allowed: str) -> Column:
    return kind.isNull() | kind.isin(*allowed)


def parse_requests(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of ``lines`` and: request_id, input_text, context, process_with_llm, output_schema, reader_error.

    Absent: ``context`` is null (an empty one), ``process_with_llm`` false, ``output_schema`` null.
    """
    df = lines.select("*", F.try_parse_json(F.col(line)).alias("__v"))
    names = ("request_id", "input_text", "context", "process_with_llm", "output_schema")
    df = df.select("*", *[_field(n).alias(f"__{n}") for n in names], _kind(F.col("__v")).alias("__kind"))
    df = df.select("*", *[_kind(F.col(f"__{n}")).alias(f"__{n}_kind") for n in names])
    kind = lambda n: F.col(f"__{n}_kind")
    asked = F.lower(F.try_variant_get(F.col("__process_with_llm"), "$", "string"))
    asked = F.when(asked.isin(*TRUE_WORDS), True).when(asked.isin(*FALSE_WORDS), False)
    error = (
        F.when(F.col("__v").isNull(), "broken_json")
        .when(F.col("__kind") != "OBJECT", "not_an_object")
        .when(~_of_kind(kind("input_text"), "STRING"), "input_text_type")
        .when(~_of_kind(kind("context"), "OBJECT"), "context_type")
        .when(kind("process_with_llm").isNotNull() & asked.isNull(), "process_with_llm_type")
        .when(~_of_kind(kind("output_schema"), "OBJECT", "VOID"), "output_schema_type")
    )
    df = df.select("*", error.alias("reader_error"))
    good = F.col("reader_error").isNull()
    text = lambda n: F.try_variant_get(F.col(f"__{n}"), "$", "string")
    given = good & (kind("output_schema") == "OBJECT")
    return df.select(
        *lines.columns,
        F.when(F.col("__kind") == "OBJECT", text("request_id")).alias("request_id"),
        F.when(good, text("input_text")).alias("input_text"),
        F.when(good & kind("context").isNotNull(), F.col("__context")).alias("context"),
        (good & F.coalesce(asked, F.lit(False))).alias("process_with_llm"),
        F.when(given, F.col("__output_schema")).alias("output_schema"),
        "reader_error",
    )


def contract(requests: DataFrame) -> DataFrame:
    """``output_schema`` as output_type, output_required, output_schema_given and output_error."""
    part = lambda n, t: F.try_variant_get(F.col("output_schema"), f"$.{n}", t)
    df = requests.select("*", _kind(part("type", "variant")).alias("__tk"), _kind(part("required", "variant")).alias("__rk"))
    kinds = F.schema_of_variant(part("required", "variant"))
    # empty values count as absent
    listed = F.try_variant_get(F.col("output_schema"), "$.required", "array<string>")
    bad_type = (F.col("__tk").isin("ARRAY", "OBJECT")) & (F.to_json(part("type", "variant")).isin("[]", "{}") == F.lit(False))
    bad_required = F.col("__rk").isNotNull() & ~F.col("__rk").isin("VOID", "ARRAY") & ~F.to_json(part("required", "variant")).isin('""', "0", "false", "{}")
    bad_required = bad_required | ((F.col("__rk") == "ARRAY") & ~kinds.isin("ARRAY<STRING>", "ARRAY<VOID>"))
    error = F.when(bad_type, F.concat(F.lit("unhashable type: '"), F.when(F.col("__tk") == "ARRAY", "list").otherwise("dict"), F.lit("'")))
    error = error.when(bad_required, F.lit("required properties are not a list of strings"))
    return df.select(
        *requests.columns,
        F.when(F.col("__tk") == "STRING", part("type", "string")).alias("output_type"),
        F.when(F.col("__rk") == "ARRAY", F.coalesce(F.filter(listed, lambda x: x.isNotNull()), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>"))
        .alias("output_required"),
        F.col("output_schema").isNotNull().alias("output_schema_given"),
        error.alias("output_error"),
    )


def quarantine(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, broken lines)."""
    return requests.where("reader_error IS NULL"), requests.where("reader_error IS NOT NULL")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of JSON-lines files that are not blank."""
    return spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")


def read_lines_stream(spark: SparkSession, path: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    lines = spark.readStream.option("maxBytesPerTrigger", bytes_per_batch).text(path)
    return lines.withColumnRenamed("value", "line").where(F.trim("line") != "")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests with their contracts, from JSON lines; broken lines with their ``reader_error``."""
    return contract(parse_requests(read_lines(spark, path))).drop("output_schema")


def read_requests_stream(spark: SparkSession, path: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    return contract(parse_requests(read_lines_stream(spark, path, bytes_per_batch))).drop("output_schema")
