"""Data checks. Each returns the violations; a check passes when there are none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.functions import joined_key


def unique(frame: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once. NULL is not a value."""
    values = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
    return values.agg(F.count("*").alias("n")).where(F.col("n") > 1)


def unique_combination(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys ``a-b-c`` that occur more than once.

    A key with a missing part is NULL, and NULL counts as a key, so two of them fail. Rows are
    grouped by the typed parts; the text is built for the violations only.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    names = [f"_part{i}" for i in range(len(columns))]
    parts = [F.when(complete, F.col(c)).alias(n) for c, n in zip(columns, names)]
    counted = frame.groupBy(*parts).agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1)
    return counted.select(joined_key(*names).alias("key"), F.col("_rows").alias("n"))


def not_null(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNull())


def not_accepted(column: str, values: Sequence[str]) -> Column:
    """True for a value outside the list; NULL passes."""
    return ~F.col(column).isin(*values)


def accepted_values(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the list, with their number of rows."""
    bad = frame.where(not_accepted(column, values))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def relationships(frame: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Values without a parent row, with their number of rows.

    Children are counted per value first, so the join meets each value once: a hot key cannot
    skew it.
    """
    children = (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    known = parent.select(F.col(field).alias("value"))
    return children.join(known, "value", "left_anti")


def one_of_each(frame: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys that do not have exactly one row with ``flag`` and one without."""
    sides = frame.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("n_true"),
    )
    return sides.where((F.col("n") != 2) | (F.col("n_true") != 1))
