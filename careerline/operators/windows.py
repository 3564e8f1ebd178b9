"""Running totals and per-group picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerline.operators.dedupe import keep_first


def running_totals(
    frame: DataFrame, group: Sequence[str], order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Cumulative sums over ``group`` in ``order``: ``{new_column: summed expression}``.

    Feed it pre-aggregated rows: one task walks through each group.
    """
    career = (
        Window.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return frame.withColumns({name: F.sum(c).over(career) for name, c in totals.items()})


def best_per_group(frame: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The top row per group."""
    return keep_first(frame, group, order)


def last_per_group(
    frame: DataFrame, group: Sequence[str], by: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """``values`` of the row with the greatest ``by``: an aggregate with a map-side combine."""
    picked = F.max_by(F.struct(*values), F.struct(*by)).alias("_picked")
    return frame.groupBy(*group).agg(picked).select(*group, "_picked.*")
