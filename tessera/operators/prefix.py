"""Running sums over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize


def sums_before(rows: DataFrame, order: list[str | Column], **values: Column) -> DataFrame:
    """``rows`` with, for each of ``values``, its sum over all rows that come before in ``order`` (0 for the first).

    Rows are dealt into ranges of the order and written. Each range is summed in a task of its own; what meets in one task is a row per
    range, so its size, and that of the side that is broadcast, is the number of partitions. Keys should be unique: rows
    that tie come in any order, all in one range.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range_no").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("range_no").alias("range_of"), *[F.sum(k).over(earlier).alias(f"{k}_start") for k in values])
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(starts), F.col("range_no") == F.col("range_of"))
    sums = [(F.coalesce(f"{k}_start", F.lit(0)) + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(k) for k, v in values.items()]
    return placed.select(*rows.columns, *sums)


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1, as column ``name``."""
    return sums_before(rows, order, **{name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("long"))
