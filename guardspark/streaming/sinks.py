"""Sinks that can be repeated.

``write_verdicts`` keeps verdicts by day, nested results included: a day that is written again
replaces that day alone.

``VaultSink`` writes a stream's tokenized texts and its vault as two tables, a
folder ``batch=<id>`` per micro-batch in each.  Both folders are replaced as a
whole, and tokens depend on the request and value alone: a batch that is run again after
a failure, at whatever point, leaves both tables as they would be without it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.operators import vault as V

TOKENIZED_SCHEMA = "request_id string, tokenized_text string, vault_pairs " + V.PAIR_TYPE


@dataclass(frozen=True)
class VaultSink:
    """Tokenized texts and vault of a stream under ``path`` (a shared folder with restricted access)."""

    path: str
    types: tuple[str, ...]
    secret: str
    text: str = "text"
    request_id: str = "request_id"

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Replace the two folders of one micro-batch.  The regex work runs
        once: the vault is read back from the pairs of the texts just written."""
        spark = batch.sparkSession
        texts = f"{self.path}/tokenized/batch={batch_id}"
        V.tokenize(batch, self.text, self.request_id, list(self.types), self.secret).select(
            F.col(self.request_id).cast("string").alias("request_id"), "tokenized_text", "vault_pairs"
        ).write.mode("overwrite").parquet(texts)
        stored = spark.read.schema(TOKENIZED_SCHEMA).parquet(texts)
        V.vault_table(stored).dropDuplicates(["request_id", "token", "value"]).write.mode("overwrite").parquet(
            f"{self.path}/vault/batch={batch_id}"
        )

    def run(self, stream: DataFrame) -> None:
        """Take all that is available, in as many batches as the source deals it in."""
        query = (
            stream.writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", f"{self.path}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def tokenized(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.schema(TOKENIZED_SCHEMA).parquet(f"{self.path}/tokenized/batch=*")
        return rows.select("request_id", "tokenized_text")

    def vault(self, spark: SparkSession) -> DataFrame:
        """(request_id, token, pii_type, value); a request in several batches has its tokens once."""
        schema = "request_id string, token string, pii_type string, value string"
        rows = spark.read.schema(schema).parquet(f"{self.path}/vault/batch=*")
        return rows.dropDuplicates(["request_id", "token", "value"])


def write_verdicts(verdicts: DataFrame, path: str, day: str = "day") -> None:
    """Write verdicts into ``path/day=<day>``: the days that occur in ``verdicts`` are replaced, all
    others stay.  A large day is split over several files."""
    held = verdicts.hint("rebalance", day)
    held.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(day).parquet(path)


def replace_day(verdicts: DataFrame, path: str, value, day: str = "day") -> None:
    """Replace one day by its rows of ``verdicts``, also where none are left."""
    verdicts.where(F.col(day) == F.lit(value)).drop(day).write.mode("overwrite").parquet(f"{path}/{day}={value}")


def read_verdicts(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
