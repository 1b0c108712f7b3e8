"""Find-all over very long texts (B9): one row's work over several tasks.

A text is cut into chunks of ``CHUNK_CHARS`` or more, each up to the next white space between
two ASCII letters.  No personal-data pattern matches across such a place, and what its boundary
conditions see on either side is the same with and without the cut, so the matches of the
chunks, one after the other, are those of one walk over the whole text.  A text without such a place
stays one chunk.

Chunks are dealt over the tasks; each match gets its place in the whole text by adding the counts
of the chunks before, one row per chunk and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardspark.functions import patterns as P
from guardspark.functions import pii

CHUNK_CHARS = 1 << 20


def chunks(docs: DataFrame, text: str, keys: list[str], chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(keys..., __row, chunk_no, chunk): the chunks of each text, dealt over the tasks."""
    piece = rf"(?s).{{{chunk_chars}}}.*?(?<=[A-Za-z])[ \t\n](?=[A-Za-z])|.+"
    whole = F.length(text) <= chunk_chars
    cut = F.when(whole, F.array(F.col(text))).otherwise(F.regexp_extract_all(F.col(text), F.lit(piece), F.lit(0)))
    rows = docs.select(*keys, text, F.monotonically_increasing_id().alias("__row"))
    return rows.select(*keys, "__row", F.posexplode(cut).alias("chunk_no", "chunk")).repartition("__row", "chunk_no")


def pii_values(
    docs: DataFrame, text: str, keys: list[str], types: list[str] | None = None, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """B9 long form, as ``audit.pii_values``: one row per match (keys..., pii_type, pos, value)."""
    per_type = F.array(
        *[F.struct(F.lit(t).alias("pii_type"), pii.matches(F.col("chunk"), t).alias("values")) for t in types or list(P.PII_PATTERNS)]
    )
    found = chunks(docs, text, keys, chunk_chars).select(*keys, "__row", "chunk_no", F.inline(per_type)).where(F.size("values") > 0)
    before = Window.partitionBy("__row", "pii_type").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("__before", F.coalesce(F.sum(F.size("values")).over(before), F.lit(0)))
    return placed.select(*keys, "pii_type", "__before", F.posexplode("values").alias("__at", "value")).select(
        *keys, "pii_type", (F.col("__before") + F.col("__at")).cast("int").alias("pos"), "value"
    )
