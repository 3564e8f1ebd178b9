"""Two-sided records (winner/loser, buyer/seller) to one row per side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sided(
    frame: DataFrame,
    common: Sequence[str],
    first: Mapping[str, Column | str],
    second: Mapping[str, Column | str],
    flag: str,
) -> DataFrame:
    """One row per side; ``flag`` is true on the first side.

    Both sides come out of a single scan (an inlined two-element array) instead of a union of
    two projections, which would read the input twice.
    """

    def side(columns: Mapping[str, Column | str], is_first: bool) -> Column:
        fields = [
            (F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()
        ]
        return F.struct(*fields, F.lit(is_first).alias(flag))

    return frame.select(*common, F.inline(F.array(side(first, True), side(second, False))))
