"""Join helpers: broadcasting with a proven bound, and role-playing dimensions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small_side(frame: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when ``rows``, a proven upper bound of ``frame``, is small.

    Beyond the limit the hint is left off: Spark then joins by shuffle, with adaptive skew
    splitting for hot keys. The result is the same either way.
    """
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def as_role(dimension: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One role of a dimension that is joined several times: ``{role_column: column}``."""
    return dimension.select(*[F.col(source).alias(role) for role, source in columns.items()])
