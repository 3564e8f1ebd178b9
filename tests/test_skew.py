"""Hot keys against plain counts and the plain join."""

import datetime
import random
from collections import Counter
from contextlib import contextmanager
from statistics import median

import pytest
from pyspark.sql import functions as F

from careerline.operators import heavy_hitters, local_frame, spread_left_join
from careerline.plans import marts
from careerline.sources import seeds

D = datetime.date


@contextmanager
def settings(spark, **named):
    given = {f"spark.sql.{k.replace('__', '.')}": v for k, v in named.items()}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(spark):
    """Neither broadcast joins nor adaptive splitting."""
    return settings(
        spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false", shuffle__partitions="8"
    )


@pytest.mark.parametrize("share", [0.3, 0.05, 0.004])
def test_heavy_hitters_are_all_and_exact(spark, share):
    rng = random.Random(3)
    data = [rng.choice([None, 7, 7, 7, int(rng.paretovariate(0.7)), rng.randrange(100_000)]) for _ in range(20_000)]
    frame = local_frame(spark, [(k, "x") for k in data], "k long, x string").repartition(6)
    found = {r["k"]: r["n"] for r in heavy_hitters(frame, "k", share).collect()}
    assert found == {k: n for k, n in Counter(data).items() if n >= share * len(data)}


def test_heavy_hitters_of_nothing_and_of_ties(spark):
    assert heavy_hitters(local_frame(spark, [], "k string"), "k", 0.1).collect() == []
    even = local_frame(spark, [(str(i % 10),) for i in range(100)], "k string")
    assert sorted(r["k"] for r in heavy_hitters(even, "k", 0.1).collect()) == [str(i) for i in range(10)]
    with pytest.raises(ValueError):
        heavy_hitters(even, "k", 1e-6)


def test_a_spread_join_is_the_plain_join(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(50)]), rng.randrange(5)) for _ in range(4_000)]
    left = local_frame(spark, rows, "k int, v int").withColumn("m", F.create_map(F.lit("a"), "v"))
    # No parent, several parents, and a parent without a key.
    parent = local_frame(spark, [(i, f"p{i}-{j}") for i in range(40) for j in range(i % 3)] + [(None, "none")], "k int, name string")
    with shuffled(spark):
        plain = left.join(parent, "k", "left").select("k", "v", "name").collect()
        for partitions in (None, 1, 200):
            spread = spread_left_join(left, parent, "k", partitions)
            assert spread.columns == ["k", "v", "m", "name"]
            assert Counter(spread.select("k", "v", "name").collect()) == Counter(plain)
        nothing = spread_left_join(left.limit(0), parent, "k").collect()
    assert nothing == []
    assert spread_left_join(left, parent.limit(0), "k").where("name is not null").count() == 0


def _most_over_median(frame):
    sizes = sorted(r["count"] for r in frame.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert len(sizes) == 8
    return sizes[-1] / median(sizes)


@pytest.mark.parametrize("hot", ["cast(1 as bigint)", "cast(null as bigint)"])
@pytest.mark.parametrize("repeated", [False, True])
def test_no_task_is_above_twice_the_median(spark, hot, repeated):
    """One key, or no key, on 80 % of the rows; in one case these rows are all equal."""
    value = F.lit(0) if repeated else F.col("id")
    rows = spark.range(0, 200_000, 1, 64).select(
        F.when(F.col("id") % 10 < 8, F.expr(hot)).otherwise(F.xxhash64("id") % 5_000).alias("k"),
        value.alias("v"),
    )
    parent = spark.range(-5_000, 5_000).select(F.col("id").alias("k"), F.lit("p").alias("p"))
    with shuffled(spark):
        assert _most_over_median(rows.join(parent, "k", "left")) > 10
        assert _most_over_median(spread_left_join(rows, parent, "k")) < 2


def test_player_rows_without_adaptive_splitting(spark):
    """One winner holds 80 % of the matches, and a tenth have no winner."""
    n = 60_000
    winner = F.when(F.col("id") % 10 < 8, F.lit(1)).when(F.col("id") % 10 == 8, None).otherwise(F.col("id") % 5000)
    matches = spark.range(0, n, 1, 16).select(
        F.concat(F.lit("m"), "id").alias("match_id"),
        *[F.lit(c).alias(c) for c in ("tourney_id", "tourney_name", "surface", "round_code")],
        F.lit("G").alias("tourney_level"),
        F.lit(D(2010, 1, 1)).alias("tourney_date"),
        F.lit(3).alias("best_of"),
        F.lit(False).alias("is_incomplete"),
        winner.cast("long").alias("winner_id"),
        (F.col("id") % 4999 + 6000).alias("loser_id"),
        F.lit(1).alias("winner_rank"),
        F.lit(2).alias("loser_rank"),
    )
    births = spark.range(12_000).select(F.col("id").alias("player_id"), F.lit(D(1980, 1, 1)).alias("date_of_birth"))
    with shuffled(spark):
        rows = marts.int_player_matches(matches, births, seeds.tourney_levels(spark))
        assert _most_over_median(rows) < 2
        assert rows.count() == 2 * n
        assert rows.where(F.col("date_of_birth").isNull()).count() == n // 10
