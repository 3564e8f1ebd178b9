"""Spark side of the models, marts, reports and checks."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerline.operators import heavy_hitters, local_frame, quality, spread_left_join, with_positions
from careerline.plans import checks, marts, reports
from careerline.plans.build import FACT, refresh_fact
from careerline.sources.warehouse import Warehouse
from registry.feed import feed_for

Query = Callable[[SparkSession, str], DataFrame]

MODELS = (
    "stg_matches",
    "stg_players",
    "stg_rankings",
    "int_player_matches",
    "dim_players",
    "mart_no1_weeks",
    "mart_slam_titles",
    "mart_age_curves",
    "mart_pace_comparison",
    "mart_big3_era_slams",
    "mart_vs_big3_h2h",
)
LAST_LOAD = datetime.date(2011, 1, 31)


def _model(name: str) -> Query:
    return lambda spark, sf_dir: getattr(feed_for(spark, sf_dir), name)


def _report(build: Callable[..., DataFrame], *inputs: str, **options: object) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        feed = feed_for(spark, sf_dir)
        given = [feed.stored(i) for i in inputs if i != "fct_player_matches"]
        if "fct_player_matches" in inputs:
            given.append(feed.fct_player_matches)
        return build(*given, **options)

    return query


def raw_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the raw tables side by side, from the footers of their files."""
    feed = feed_for(spark, sf_dir)
    names = ("matches", "players", "rankings")
    counts = tuple(feed.warehouse.row_count(feed.stored_table(f"raw_{name}")) for name in names)
    return local_frame(spark, [counts], ", ".join(f"{name} long" for name in names))


def _refreshed(spark: SparkSession, sf_dir: str, full_refresh: bool) -> DataFrame:
    """The stored fact after two builds' refreshes, of which the second follows a late load.

    The target holds what was known on the last load, with surfaces that were corrected since;
    the source has newer matches and has lost those of unknown level.
    """
    feed = feed_for(spark, sf_dir)
    current = feed.fct_player_matches
    target = current.where(F.col("tourney_date") <= F.lit(LAST_LOAD)).withColumn(
        "surface", F.lit("Unknown")
    )
    source = current.where(F.col("tourney_level") != "X")
    warehouse = Warehouse(spark, f"{feed.folder}/refresh-{uuid.uuid4().hex}")
    with warehouse.publishing():
        refresh_fact(warehouse, target)
    with warehouse.publishing():
        refresh_fact(warehouse, source, full_refresh)
    return warehouse.read(FACT)


def fct_player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir, full_refresh=False)


def fct_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir, full_refresh=True)


def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique(feed_for(spark, sf_dir).stored("raw_players"), "player_id")


def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = feed_for(spark, sf_dir).stored("stg_matches")
    return quality.not_null(matches, "winner_id").select("match_id", "winner_id", "loser_id")


def check_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted_values(feed_for(spark, sf_dir).stored("stg_matches"), "surface", checks.SURFACES)


def check_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feed_for(spark, sf_dir)
    return quality.relationships(
        feed.fct_player_matches, "player_id", feed.stored("stg_players"), "player_id"
    )


def check_unique_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = feed_for(spark, sf_dir).stored("raw_rankings")
    return quality.unique_combination(rankings, ["ranking_date", "player"])


def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of all layers with their number of violations."""
    feed = feed_for(spark, sf_dir)
    names = {c.table for c in checks.ALL_CHECKS} - {"fct_player_matches"}
    tables = {name: feed.stored(name) for name in names}
    fact = {"fct_player_matches": feed.fct_player_matches}
    return checks.check_report({"tourney_levels": feed.levels.frame, **fact, **tables}, checks.ALL_CHECKS)


def pace_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same-age comparison with the place of every row in its order."""
    feed = feed_for(spark, sf_dir)
    order = [*marts.pace_order(), F.asc_nulls_last("player_name")]
    return with_positions(feed.stored("mart_pace_comparison"), order, feed.keep)


def curves_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age curves with the place of every row by player and age."""
    feed = feed_for(spark, sf_dir)
    order = [F.asc_nulls_last("player_id"), F.asc_nulls_last("age_year")]
    return with_positions(feed.stored("mart_age_curves"), order, feed.keep)


def hot_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players on at least 2 % of all player rows, with exact counts."""
    return heavy_hitters(feed_for(spark, sf_dir).fct_player_matches, "player_id", 0.02)


def winners_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its winner's name and country; hot winners' matches are joined in slices."""
    feed = feed_for(spark, sf_dir)
    matches = feed.stored("stg_matches").select("match_id", F.col("winner_id").alias("player_id"))
    players = feed.stored("stg_players").select("player_id", "player_name", "country_code")
    return spread_left_join(matches, players, "player_id")


MODEL_QUERIES: dict[str, Query] = {
    **{name: _model(name) for name in MODELS},
    "raw_table_counts": raw_table_counts,
    "fct_player_matches": fct_player_matches,
    "fct_full_refresh": fct_full_refresh,
    "report_headline": _report(reports.headline, "mart_pace_comparison"),
    "report_anchor_count": _report(reports.anchor_count, "mart_pace_comparison"),
    "report_same_age_table": _report(reports.same_age_table, "mart_pace_comparison"),
    "report_pace_bars": _report(reports.pace_bars, "mart_pace_comparison"),
    "report_curve_table": _report(
        reports.curve_table, "mart_age_curves", players=["Bravo", "Delta", "Golf"]
    ),
    "report_focus_slots": _report(reports.focus_slots, "mart_age_curves"),
    "report_era_split": _report(reports.era_split, "mart_big3_era_slams"),
    "report_other_champions": _report(reports.other_champions, "mart_big3_era_slams"),
    "report_other_titles": _report(reports.other_titles, "mart_big3_era_slams"),
    "report_challenger_finals": _report(reports.challenger_finals, "mart_vs_big3_h2h"),
    "report_head_to_head_table": _report(reports.head_to_head_table, "mart_vs_big3_h2h"),
    "report_all_titles": _report(reports.all_titles, "mart_slam_titles"),
    "report_cutoff_caption": _report(
        reports.cutoff_caption, "mart_slam_titles", "fct_player_matches"
    ),
    "check_unique": check_unique,
    "check_not_null": check_not_null,
    "check_accepted_values": check_accepted_values,
    "check_relationships": check_relationships,
    "check_unique_combination": check_unique_combination,
    "check_report": check_report,
    "hot_players": hot_players,
    "winners_spread": winners_spread,
    "pace_in_order": pace_in_order,
    "curves_in_order": curves_in_order,
}
for _metric in reports.METRICS:
    MODEL_QUERIES[f"report_series_{_metric}"] = _report(
        reports.metric_series, "mart_age_curves", metric=_metric
    )
    MODEL_QUERIES[f"report_exported_series_{_metric}"] = _report(
        reports.exported_series, "mart_age_curves", metric=_metric
    )
    MODEL_QUERIES[f"report_line_ends_{_metric}"] = _report(
        lambda curves, metric: reports.line_ends(reports.exported_series(curves, metric)),
        "mart_age_curves",
        metric=_metric,
    )
