"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009..U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared by the driver and
    all executors.  Only where it is unset in a local session (tests) a scratch folder is made; on a
    cluster nothing else would be seen by all, so that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders made by this driver, for ``clear_folders``.
_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def clear_folders(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far, once all results that are
    read from them are written; returns how many folders there were."""
    conf, n = spark._jsc.hadoopConfiguration(), len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


#: Rows of an Arrow batch between the JVM and Python while a table is staged.
ARROW_ROWS = 1000
#: And its bytes, about (a row at least): a thousand long texts are far more than a worker should hold.
ARROW_BYTES = 8 << 20
_ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> Iterator[None]:
    """While a job runs, Arrow batches of few rows and bytes: texts are long, and a batch
    stands in the memory of both sides.  The session's own settings come back
    afterwards; results do not depend on them."""
    before, bytes_before = spark.conf.get(_ARROW_KEY), spark.conf.get(_ARROW_BYTES_KEY, None)
    spark.conf.set(_ARROW_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    # the bytes are read as a size with a unit, and only a plain number can be compared here
    own = int(bytes_before.removesuffix("b")) if bytes_before and bytes_before.removesuffix("b").isdigit() else None
    if bytes_before is None or own is not None:
        spark.conf.set(_ARROW_BYTES_KEY, str(min(size, own) if own else size))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_KEY, before)
        if bytes_before is None:
            spark.conf.unset(_ARROW_BYTES_KEY)
        else:
            spark.conf.set(_ARROW_BYTES_KEY, bytes_before)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at a place every executor can reach, so a lost
    executor costs at most the stage being run, and columns that are not
    deterministic across recomputation (row ids) are fixed from here on.
    """
    path = fresh_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it
    (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def in_slices(batches: Iterator, rows: int = 300) -> Iterator:
    """Arrow batches in slices of at most ``rows``, so that a Python worker
    holds the texts of few documents at a time, and what pyarrow has freed
    goes back to the system after each batch."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def words_col(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank give ``[]``."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN, -1))


def n_words_col(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_RUN, -1))).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
