"""Positions of rows in a global order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(
    frame: DataFrame, order: Sequence[Column], store: Callable[[DataFrame], DataFrame], name: str = "position"
) -> DataFrame:
    """``frame`` with the place of each row, from 1, in ``order``; rows that tie in all of it are placed as they come.

    A range sort deals the rows, ``store`` keeps them as they are dealt, and the rows of whole partitions are added up
    over one row per partition. So no task holds more than a range, and a million rows of one key are spread if
    ``order`` goes on behind it.
    """
    dealt = store(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counted = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ahead = counted.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_inside", inside).join(ahead, "_range")
    return placed.withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_range", "_ahead", "_inside")
