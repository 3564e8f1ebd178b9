"""Figures that Parquet files carry in their footers: numbers of rows, least and greatest values.

Spark's second Parquet reader answers such aggregates from the footers alone, as long as nothing but
partition columns is filtered or grouped by. It is off by default; a session of its own turns it on, so that other
reads of the program are planned as before.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@lru_cache(maxsize=4)
def _beside(spark: SparkSession) -> SparkSession:
    return spark.newSession()


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that reads aggregates from footers; it has the settings that ``spark`` has now."""
    session = _beside(spark)
    given = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.") and spark.conf.isModifiable(k)}
    for name, value in {**given, **SETTINGS}.items():
        session.conf.set(name, value)
    return session


def row_count(frame: DataFrame) -> int:
    """The rows of a frame of :func:`footer_session`, whose sum over no files is NULL."""
    return frame.agg(F.count("*")).first()[0] or 0
