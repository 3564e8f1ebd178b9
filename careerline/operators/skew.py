"""Hot keys: found by a frequency sketch, and joined without a task that holds one of them whole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this part of a shuffle partition's even share of the rows on.
HOT_PART = 0.5
#: Slices that a hot key has for each partition that its rows would fill.
SLICES = 32
#: Most items that the sketch of ``approx_top_k`` can track.
MOST_TRACKED = 1_000_000


def _sketched(frame: DataFrame, key: str, share: float) -> DataFrame:
    """``item, count, total``: every key, NULL among them, that holds ``share`` of the rows, and a few below it.

    The sketch tracks 28 items for each key that can be as large; its error is 3.5 rows per tracked
    item, so at most an eighth of ``share``, and twice as many keys are read from it as can be that large.
    """
    most = math.ceil(1 / share)
    if 28 * most > MOST_TRACKED:
        raise ValueError(f"a share of {share} is below what the sketch tells: {28 / MOST_TRACKED}")
    top = F.call_function("approx_top_k", F.col(key), F.lit(2 * most), F.lit(28 * most))
    sketch = frame.agg(top.alias("top"), F.count("*").alias("total"))
    return sketch.select(F.inline("top"), "total")


def heavy_hitters(frame: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n, total) of every key that holds at least ``share`` of all rows, with exact counts.

    A sketch of a bounded size names the candidates in one scan; a second scan counts these alone, so keys are
    shuffled in number of candidates and not of rows or of distinct keys. NULL is a key; no rows give none.
    """
    candidates = _sketched(frame, key, share).select(F.col("item").alias("_item"), F.col("total").alias("_total"))
    same = F.col(key).eqNullSafe(F.col("_item"))
    counted = frame.select(key).join(F.broadcast(candidates), same).groupBy(key).agg(
        F.count("*").alias("n"), F.max("_total").alias("total")
    )
    return counted.where(F.col("n") >= F.lit(share) * F.col("total"))


def _slice_counts(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """``_hot, _slices``: the hot keys of ``rows`` and into how many slices each is cut; at most ``8 * partitions`` rows."""
    share = max(HOT_PART / partitions, 28 / MOST_TRACKED)
    hot = _sketched(rows, key, share).where(F.col("count") >= F.lit(share) * F.col("total"))
    slices = F.ceil(F.col("count") / F.col("total") * partitions * SLICES).cast("int")
    return hot.select(F.col("item").alias("_hot"), slices.alias("_slices"))


def _spread(rows: DataFrame) -> list:
    """What a row's slice is taken from: its values, and the task it is in, so that equal rows are spread as well.

    Both are the same when a task runs again. Values that cannot be hashed are left out.
    """
    plain = [f.name for f in rows.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return [F.spark_partition_id(), *[F.col(f"`{name}`") for name in plain]]


def splits_adaptively(spark: SparkSession) -> bool:
    """Whether Spark itself splits a partition of a shuffle join that is far larger than the others."""
    return all(spark.conf.get(f"spark.sql.adaptive.{name}") == "true" for name in ("enabled", "skewJoin.enabled"))


def hot_left_join(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """``rows.join(parent, key, "left")``: left to adaptive skew splitting where that is on, spread where it is not."""
    if splits_adaptively(rows.sparkSession):
        return rows.join(parent, key, "left")
    return spread_left_join(rows, parent, key)


def spread_left_join(rows: DataFrame, parent: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``rows.join(parent, key, "left")`` for keys of which one may hold most rows.

    A sketch finds the keys that hold half of a shuffle partition's share or more. Their rows are cut into slices that are
    shuffled on their own, and their parent rows copied once for each slice (at most ``SLICES`` copies a
    partition, over all keys, and one per key). Rows without a key are sliced too: they find no parent, wherever they are. The
    result holds for any number of parent rows per key; only the order of rows differs from the plain join.
    It costs a scan of the key column before the join, and does not depend on adaptive skew splitting.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(_slice_counts(rows, key, partitions))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    slices = F.coalesce("_slices", F.lit(1))
    slice_of = F.pmod(F.xxhash64(*_spread(rows)), slices).cast("int")
    left = rows.join(hot, same, "left").withColumn("_slice", slice_of).drop("_hot", "_slices")
    copies = F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice")
    right = parent.where(F.col(key).isNotNull()).join(hot, same, "left").select(*parent.columns, copies)
    return left.join(right, [key, "_slice"], "left").drop("_slice")
