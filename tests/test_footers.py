"""Counts and extremes from the files' footers."""

import datetime

import pytest
from pyspark.sql import functions as F

from careerline.plans.build import FACT, newest_day
from careerline.sources.footers import footer_session
from careerline.sources.warehouse import Warehouse

D = datetime.date


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "w"))


def _days(spark, n):
    day = F.date_add(F.lit(D(2010, 1, 1)), F.col("id").cast("int"))
    return spark.range(n).select("id", F.when(F.col("id") % 7 > 0, day).alias("tourney_date"))


def _season():
    return F.coalesce(F.year("tourney_date"), F.lit(-1)).cast("string")


def test_no_column_is_read_for_counts_and_the_newest_day(spark, warehouse):
    written = warehouse.replace_parts(FACT, _days(spark, 1000), _season(), ["-1", "2010", "2011", "2012", "2013"])
    assert written == {"-1": 143, "2010": 312, "2011": 313, "2012": 232, "2013": 0}
    asked = warehouse.read_footers(FACT, ["2011", "2012"]).agg(F.count("*").alias("n"), F.max("tourney_date").alias("day"))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(tourney_date)]" in plan
    assert asked.first() == (545, D(2012, 9, 26))
    assert warehouse.row_count(FACT) == 1000
    assert spark.range(1).select(newest_day(warehouse)).first()[0] == D(2012, 9, 26)


def test_counts_by_part_are_pushed_down(spark, warehouse):
    warehouse.replace_parts("a/t", _days(spark, 100), _season(), ["-1", "2010"])
    folder = warehouse.snapshot("a/t")[0][1].rsplit("/", 1)[0]
    counted = footer_session(spark).read.schema("_part string").parquet(folder).groupBy("_part").count()
    assert "PushedGroupBy: [_part]" in counted._jdf.queryExecution().executedPlan().toString()


def test_tables_without_rows(spark, warehouse):
    warehouse.replace("a/whole", _days(spark, 0))
    assert warehouse.replace_parts("a/parts", _days(spark, 0), _season(), ["2010"]) == {"2010": 0}
    assert warehouse.row_count("a/whole") == warehouse.row_count("a/parts") == 0
    warehouse.replace_parts(FACT, _days(spark, 1), _season(), ["-1"])
    assert spark.range(1).select(newest_day(warehouse)).first()[0] is None


def test_other_reads_are_planned_as_before(spark, warehouse):
    given = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert footer_session(spark).conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert footer_session(spark).conf.get("spark.sql.shuffle.partitions") == "8"
    warehouse.replace("a/t", _days(spark, 10))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == given
    assert "FileScan parquet" in warehouse.read("a/t")._jdf.queryExecution().executedPlan().toString()
