"""Responses as a stream (A4, H1): a stream of requests meets a stream of
model responses, and each request gets one verdict (E4).

Both sides carry event time.  A response counts if it comes no later than ``wait`` after
its request; the time bound and the watermarks bound the state of the outer
join, which holds a request until its time is over.  Matches are then gathered per
request, so two responses make one row that is marked as repeated.  A
request whose answer never comes leaves the join when the watermark passes its
bound, with no response: its verdict is the failure one.

One batch may bring a request, its response, both or neither; the rows are those of the
batch verdict, as soon as the watermark has passed them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.plans import verdict

RESPONSE, REPEATED = "__stream_response", "__stream_repeated"


def with_responses(
    requests: DataFrame,
    responses: DataFrame,
    time: str = "ts",
    response_time: str = "ts",
    response_col: str = "output_text",
    wait: str = "10 minutes",
    lateness: str = "10 minutes",
) -> DataFrame:
    """``requests`` with the columns ``RESPONSE`` and ``REPEATED``.

    A request is a (``request_id``, event time, input text): rows that agree in all three are
    one.  A null ``request_id`` meets no response.  Rows later than ``lateness`` behind
    the newest of their side are dropped by the watermark (``streaming.late`` counts such rows).
    """
    asked = requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    given = responses.select(
        F.col("request_id").alias("__rid"),
        F.col(response_time).cast("timestamp").alias("__at"),
        F.col(response_col).alias("__answer"),
    ).withWatermark("__at", lateness)
    within = (F.col("__at") >= F.col(time)) & (F.col("__at") <= F.col(time) + F.expr(f"INTERVAL {wait}"))
    joined = asked.join(given, (F.col("request_id") == F.col("__rid")) & within, "leftOuter")
    text_key = F.sha2(F.coalesce(F.col("input_text"), F.lit("")).cast("binary"), 256).alias("__text")
    rest = [c for c in requests.columns if c not in (time, "request_id")]
    return (
        joined.groupBy(time, "request_id", text_key, F.col("input_text").isNull().alias("__none"))
        .agg(
            *[F.first(c).alias(c) for c in rest],
            F.min("__answer").alias(RESPONSE),
            (F.count("__rid") > 1).alias(REPEATED),
        )
        .select(*requests.columns, RESPONSE, REPEATED)
    )


def verdicts(
    requests: DataFrame, responses: DataFrame, policy: dict[str, Any] | None = None, *, secret: str, **options: str
) -> DataFrame:
    """E4 on two streams; ``options`` as for ``with_responses``."""
    paired = with_responses(requests, responses, **options)
    return verdict.request_verdict(paired, RESPONSE, policy, secret=secret, repeated=REPEATED).drop(RESPONSE, REPEATED)
