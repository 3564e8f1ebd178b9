"""Whole rows as one column, so that their column names cannot clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def wrapped(docs: DataFrame, **named: str) -> DataFrame:
    """``row`` (all columns of ``docs``) beside the given columns under the operator's names."""
    return docs.select(
        F.struct(*map(column, docs.columns)).alias("row"), *(column(c).alias(name) for name, c in named.items())
    )


def unwrapped(df: DataFrame, columns: list[str], *added: Column, **replaced: Column) -> DataFrame:
    """The columns of the rows again, some replaced by new values, and ``added`` ones behind them."""
    fields = [replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return df.select(*fields, *added)
