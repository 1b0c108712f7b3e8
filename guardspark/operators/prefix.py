"""Sums over all rows before, without a window that one task must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.session import staged


def running(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with its place in the order (``place``, from 0) and, for each column of
    ``sums``, the sum over all rows before (``before_<column>``).

    Two levels: one range sort, staged in the shared folder; sums inside each partition, and sums
    over one row per partition.  Equal rows are ordered as the sort leaves them.
    """
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = staged(sort.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__at", 33))
    counted = held.withColumn("__one", F.lit(1).cast("long"))
    names = {"__one": "place"} | {c: f"before_{c}" for c in sums}
    parts = counted.groupBy("__part").agg(*[F.sum(c).alias(c) for c in names])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in names])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inner = counted.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, n in names.items()})
    joined = inner.join(parts, F.col("__part") == F.col("__p"))
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__{c}")).alias(n) for c, n in names.items()])
