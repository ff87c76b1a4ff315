"""Numbering rows in a total order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, name: str, *order: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: how many rows come before in ``order``, or their summed ``weight``.

    Rows are dealt by ranges of the order and kept as a table, so the ranges
    stay what they are; each range is numbered by itself, and a running sum over
    the ranges, of which there are few, gives where it begins. ``order`` should
    be unique; equal rows are numbered in any order among themselves.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    parts = cut(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.groupBy("range_no").agg(F.sum(one).alias("range_size"))
    starts = starts.select("range_no", (F.sum("range_size").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")).alias("range_start"))
    return parts.withColumn(name, F.sum(one).over(within) - one).join(F.broadcast(starts), "range_no").withColumn(name, F.col(name) + F.col("range_start")).drop("range_no", "range_start")
