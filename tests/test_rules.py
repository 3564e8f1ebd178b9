"""Rules of the models that are easy to lose, one by one."""

import datetime

import pytest
from pyspark.sql import functions as F

from careerline.operators import local_frame
from careerline.plans import marts, staging
from careerline.sources import seeds

D = datetime.date
RAW = ("tourney_id, tourney_name, surface, tourney_level, tourney_date, match_num, winner_id, loser_id, "
       "winner_rank, loser_rank, score, best_of, round, minutes")  # fmt: skip
RAW_COLUMNS = RAW.split(", ")
OPTIONAL = ["winner_rank_points", "loser_rank_points", "_source_file"]
ROSTER = [(1, "Ann", "Big 3", 1), (2, "Bea", "Big 3", 2), (3, "Cleo", "New generation", 3),
          (4, "Dot", "Big 3 era challengers", 4)]
PLAYERS = [(i, f"First{i}", "Last", "R", f"19{79 + i}0101", "ESP", "180") for i in range(1, 9)]
PLAYER_COLUMNS = "player_id long, name_first string, name_last string, hand string, dob string, ioc string, height string"


def raw(spark, *changes):
    base = dict(zip(RAW_COLUMNS, ["T1", "Us Open", "Hard", "g", "20100601", "1", "1", "5", "3", "12",
                                  "6-4 6-4", "5", "F", "120.0"]))
    data = []
    for number, change in enumerate(changes, 1):
        row = {**base, "match_num": str(number), **change}
        data.append([row.get(c) for c in RAW_COLUMNS + OPTIONAL])
    return local_frame(spark, data, ", ".join(f"{c} string" for c in RAW_COLUMNS + OPTIONAL))


def players(spark, rows=PLAYERS):
    frame = local_frame(spark, rows, PLAYER_COLUMNS)
    return staging.stg_players(frame.withColumn("player_id", F.col("player_id").cast("string")))


@pytest.fixture()
def world(spark):
    def make(*changes):
        roster = seeds.literal_seed(spark, ROSTER, seeds.ROSTER_SCHEMA)
        stg = staging.stg_matches(raw(spark, *changes))
        fct = marts.int_player_matches(stg, players(spark), seeds.tourney_levels(spark))
        return fct, marts.dim_players(players(spark), roster), roster.rows

    return make


def no_weeks(spark):
    return spark.createDataFrame(
        [], "ranking_date date, player_id long, display_name string, age_at_ranking double"
    )


def test_typing_of_matches(spark):
    r = staging.stg_matches(
        raw(spark, {"surface": "", "minutes": "95.5", "loser_rank": "x", "best_of": None})
    ).first()
    assert (r["match_id"], r["tourney_name"], r["surface"]) == ("T1-1", "US Open", None)
    assert (r["tourney_level"], r["minutes"], r["loser_rank"]) == ("G", 96, None)
    assert (r["best_of"], r["tourney_date"]) == (None, D(2010, 6, 1))


def test_ids_are_tested_on_the_raw_text(spark):
    found = staging.stg_matches(
        raw(spark, {"winner_id": None}, {"loser_id": None}, {"winner_id": "Q1"})
    ).collect()
    assert [(r["match_num"], r["winner_id"]) for r in found] == [(3, None)]


def test_matches_are_not_deduplicated(spark):
    twice = staging.stg_matches(raw(spark, {"match_num": "1"}, {"match_num": "1"}))
    assert twice.count() == 2


def test_missing_score_is_neither_complete_nor_incomplete(world):
    fct, _, _ = world({}, {"score": None}, {"score": "6-1 Def."}, {"score": "W/O"})
    assert [r[0] for r in fct.where("is_win").orderBy("match_id").select("is_incomplete").collect()] == [
        False, None, True, True,
    ]
    assert marts.counted_matches(fct).count() == 2


def test_reused_player_ids_keep_one_row(spark):
    rows = [(7, "Zoe", "A", "R", "19800101", "ESP", "180"), (7, "Amy", "B", "L", "19900101", "FRA", "170"),
            (8, "Same", "Name", "R", None, "ESP", "1"), (8, "Same", "Name", "L", "19850101", "FRA", "2")]
    frame = local_frame(spark, rows, PLAYER_COLUMNS)
    text = frame.withColumn(
        "player_id", F.when(F.col("hand") == "L", F.concat(F.lit("0"), "player_id")).otherwise(F.col("player_id").cast("string"))
    )
    found = {r["player_id"]: (r["player_name"], r["country_code"]) for r in staging.stg_players(text).collect()}
    assert found == {7: ("Amy B", "FRA"), 8: ("Same Name", "FRA")}


def test_best_rank_of_the_week(spark):
    frame = local_frame(
        spark,
        [("20200106", "5", "1", "10"), ("20200106", "3", "1", "9"), ("20200106", "3", "1", "11"),
         ("20200106", "NR", "1", "1"), ("20200106", "1", None, "1"), ("20200113", "4", "1", None)],
        "ranking_date string, rank string, player string, points string",
    )
    found = sorted(tuple(r) for r in staging.stg_rankings(frame).collect())
    assert found == [(D(2020, 1, 6), 3, 1, 11), (D(2020, 1, 13), 4, 1, None)]


def test_flags_of_the_two_sides(world):
    fct, _, _ = world({"winner_rank": "3", "loser_rank": None, "tourney_level": "z"}, {"round": "SF"})
    rows = {(r["match_id"], r["is_win"]): r for r in fct.collect()}
    won, lost = rows["T1-1", True], rows["T1-1", False]
    assert (won["vs_top10"], lost["vs_top10"]) == (None, True)
    assert (won["is_title"], lost["is_title"], rows["T1-2", True]["is_title"]) == (True, False, False)
    assert (won["is_grand_slam"], won["level_name"]) == (False, None)
    assert won["player_match_id"] == "T1-1-1" and lost["opponent_id"] == 1


def test_title_at_any_level_and_by_retirement(world):
    fct, dim, rows = world(
        {"tourney_level": "C", "winner_id": "3"}, {"score": "6-0 RET"}, {"tourney_level": "D"}
    )
    assert fct.where("is_title").count() == 3
    assert marts.mart_slam_titles(fct, dim).count() == 1  # won by retirement, still a title
    assert marts.mart_big3_era_slams(fct, dim, rows).count() == 1
    curves = marts.mart_age_curves(marts.career_tallies(fct, dim, rows), dim, no_weeks(fct.sparkSession), rows)
    assert curves.count() == 0  # not a counted match
    won = marts.slam_wins(fct)
    assert marts.mart_slam_titles(won, dim).collect() == marts.mart_slam_titles(fct, dim).collect()
    assert marts.mart_big3_era_slams(won, dim, rows).collect() == marts.mart_big3_era_slams(fct, dim, rows).collect()


def test_unknown_champion_or_finalist_drops_out(world):
    fct, dim, rows = world({"winner_id": "99"}, {"loser_id": "99"})
    assert marts.mart_slam_titles(fct, dim).count() == 1
    assert marts.mart_big3_era_slams(fct, dim, rows).count() == 0
    assert fct.where("player_id = 99 and date_of_birth is null and age_at_match is null").count() == 2


def test_era_starts_in_2005(world):
    fct, dim, rows = world({"tourney_date": "20041231"}, {"tourney_date": "20050101"})
    assert [r["season"] for r in marts.mart_big3_era_slams(fct, dim, rows).collect()] == [2005]


def test_beaten_players_in_order_of_round_code(world):
    fct, dim, rows = world(
        {"winner_id": "4", "loser_id": "1", "round": "SF"},
        {"winner_id": "4", "loser_id": "2", "round": "F"},
        {"winner_id": "4", "loser_id": "5", "round": "QF"},
    )
    found = marts.mart_big3_era_slams(fct, dim, rows).first()
    assert (found["big3_wins_in_run"], found["big3_beaten"]) == (2, "Bea (F), Ann (SF)")
    assert found["champion_group"] == "Big 3 era challengers"


def test_weeks_in_an_age_without_matches_disappear(spark, world):
    fct, dim, rows = world({"winner_id": "1", "tourney_date": "20050601"})
    age = 25.4  # of player 1 at the match
    weeks = spark.createDataFrame(
        [(D(2005, 6, 6), 1, "Ann", age), (D(2006, 6, 5), 1, "Ann", age + 1)], no_weeks(spark).schema
    )
    tallies = marts.career_tallies(fct, dim, rows)
    found = marts.mart_age_curves(tallies, dim, weeks, rows).select("age_year", "weeks_at_no1", "cum_weeks_at_no1").collect()
    assert [tuple(r) for r in found] == [(25, 1, 1)]


def test_pace_boundary_is_inclusive_on_the_exact_age(spark, world):
    fct, dim, rows = world(
        {"winner_id": "3", "loser_id": "6", "tourney_date": "20100601"},  # newest match
        {"winner_id": "1", "loser_id": "6", "tourney_date": "20080601"},
        {"winner_id": "1", "loser_id": "6", "tourney_date": "20080602"},
    )
    born = {r["player_id"]: r["date_of_birth"] for r in dim.collect()}
    limit = (D(2010, 6, 1) - born[3]).days
    tallies, newest = marts.career_tallies(fct, dim, rows), F.lit(D(2010, 6, 1))
    pace = {r["player_name"]: r for r in marts.mart_pace_comparison(tallies, newest, dim, no_weeks(spark), rows).collect()}
    reached = sum((d - born[1]).days <= limit for d in (D(2008, 6, 1), D(2008, 6, 2)))
    assert pace["Ann"]["titles"] == reached and pace["Cleo"]["titles"] == 1
    assert (pace["Bea"]["titles"], pace["Bea"]["win_pct"], pace["Bea"]["weeks_at_no1"]) == (0, None, 0)


def test_head_to_head_leaves_out_the_established(world):
    fct, dim, rows = world(
        {"winner_id": "1", "loser_id": "2"}, {"winner_id": "4", "loser_id": "1"}, {"winner_id": "4", "loser_id": "7"}
    )
    for events in (fct, marts.meetings(fct, dim, rows)):
        found = [tuple(r)[:6] for r in marts.mart_vs_big3_h2h(events, dim, rows).collect()]
        assert found == [("Dot", "Big 3 era challengers", "Ann", 1, 1, 1.0)]


def test_hot_player_is_split_by_adaptive_execution(spark, tmp_path):
    """A player with most of the rows: the join with the dimension is split, nothing is lost."""
    n = 60_000
    hot = F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 5000 + 1)
    stored = str(tmp_path / "m")
    spark.range(n).select(
        F.concat(F.lit("m"), "id").alias("match_id"),
        *[F.lit(c).alias(c) for c in ("tourney_id", "tourney_name", "surface", "round_code")],
        F.lit("G").alias("tourney_level"),
        F.lit(D(2010, 1, 1)).alias("tourney_date"),
        F.lit(3).alias("best_of"),
        F.lit(False).alias("is_incomplete"),
        hot.cast("long").alias("winner_id"),
        (F.col("id") % 4999 + 6000).alias("loser_id"),
        F.lit(1).alias("winner_rank"),
        F.lit(2).alias("loser_rank"),
    ).repartition(8).write.parquet(stored)
    births = spark.range(12_000).select(F.col("id").alias("player_id"), F.lit(D(1980, 1, 1)).alias("date_of_birth"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = marts.int_player_matches(spark.read.parquet(stored), births, seeds.tourney_levels(spark))
        found = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found) == 2 * n and all(r["date_of_birth"] for r in found)
    assert "skew=true" in plan
