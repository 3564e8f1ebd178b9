"""Small tables whose rows are known to the program."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARROW = {
    T.StringType(): pa.string(),
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.BooleanType(): pa.bool_(),
}


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """``rows`` as part of the plan itself: no task reads them and Spark knows their size."""
    fields = T.StructType.fromDDL(schema)
    columns = {
        f.name: pa.array([row[i] for row in rows], _ARROW[f.dataType])
        for i, f in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns), fields)
