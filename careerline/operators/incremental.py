"""Trailing-window refresh of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_window(target: DataFrame, source: DataFrame, date: str, days: int) -> DataFrame:
    """Source rows dated no earlier than ``days`` before the newest target row."""
    newest = target.agg(F.max(date)).scalar()
    return source.where(F.col(date) >= F.date_sub(newest, days))


def apply_window(target: DataFrame, window: DataFrame, key: str) -> DataFrame:
    """Target rows whose key is not in the window, plus the window as it is."""
    return target.join(window.select(key), key, "left_anti").unionByName(window)


def trailing_upsert(
    target: DataFrame | None,
    source: DataFrame,
    key: str,
    date: str,
    days: int = 365,
    full_refresh: bool = False,
) -> DataFrame:
    """The new content of ``target`` after a refresh from ``source``.

    Late corrections inside the window replace the old row by key; older rows and keys that
    vanished from the source stay; a full refresh takes the source as it is.
    """
    if target is None or full_refresh:
        return source
    return apply_window(target, trailing_window(target, source, date, days), key)
