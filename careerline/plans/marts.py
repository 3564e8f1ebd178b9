"""Intermediate model, dimension and marts.

Frames that hold only focus players are bounded by the roster, because the dimension has one row
per id. That bound (``roster_rows``) is what allows the broadcasts below: the fact table meets
them without a shuffle, whatever its size and however its rows are spread over players.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.functions import age_year, half_away_round, joined_key, ratio, years_between
from careerline.operators import (
    as_role,
    cohort_pairs,
    counts_up_to_point,
    head_to_head,
    hot_left_join,
    ordered_list,
    running_totals,
    small_side,
    two_sided,
)
from careerline.sources.seeds import Seed

# Level codes that count as tour level, cohort names, first day of the era.
TOUR_LEVELS = ("G", "M", "F", "A", "O")
ESTABLISHED = "Big 3"
NEWCOMERS = "New generation"
ERA_START = datetime.date(2005, 1, 1)

TOP_RANK = 10
FINAL = "F"
TALLIES = ("matches", "wins", "matches_vs_top10", "wins_vs_top10", "titles", "slam_titles")
SLAM_COLUMNS = (
    "tourney_id", "tourney_name", "tourney_date", "surface", "round_code", "player_id", "opponent_id",
    "age_at_match", "is_win", "is_grand_slam", "is_title",
)
MEETING_COLUMNS = (
    "player_id", "opponent_id", "tourney_level", "round_code", "is_incomplete", "is_win", "is_grand_slam",
)


def int_player_matches(
    matches: DataFrame, players: DataFrame, levels: Seed, more: Sequence[str] = ()
) -> DataFrame:
    """Two rows per match, one from each side, with age, level and title flags.

    The columns ``more`` of a match come last.
    """
    rows = two_sided(
        matches,
        common=[
            "match_id",
            "tourney_id",
            "tourney_name",
            "tourney_date",
            "surface",
            "tourney_level",
            "round_code",
            "best_of",
            "is_incomplete",
            *more,
        ],
        first={
            "player_id": "winner_id",
            "opponent_id": "loser_id",
            "player_rank": "winner_rank",
            "opponent_rank": "loser_rank",
        },
        second={
            "player_id": "loser_id",
            "opponent_id": "winner_id",
            "player_rank": "loser_rank",
            "opponent_rank": "winner_rank",
        },
        flag="is_win",
    )
    columns = [c for c in rows.columns if c not in more]
    births = players.select("player_id", "date_of_birth")
    levelled = rows.join(small_side(levels.frame, levels.rows), "tourney_level", "left")
    return hot_left_join(levelled, births, "player_id").select(
        joined_key("match_id", "player_id").alias("player_match_id"),
        *columns,
        F.coalesce("is_grand_slam", F.lit(False)).alias("is_grand_slam"),
        "level_name",
        "date_of_birth",
        years_between("date_of_birth", "tourney_date").alias("age_at_match"),
        (F.col("opponent_rank") <= TOP_RANK).alias("vs_top10"),
        ((F.col("round_code") == FINAL) & F.col("is_win")).alias("is_title"),
        *more,
    )


def dim_players(players: DataFrame, roster: Seed) -> DataFrame:
    """Players with their display name and, for focus players, cohort and slot."""
    focus = roster.frame.withColumn("_listed", F.lit(True))
    return players.join(small_side(focus, roster.rows), "player_id", "left").select(
        "player_id",
        "player_name",
        F.coalesce("display_name", "player_name").alias("display_name"),
        "cohort",
        "colour_slot",
        F.col("_listed").isNotNull().alias("is_focus_player"),
        "hand",
        "date_of_birth",
        "country_code",
        "height_cm",
    )


def counted_matches(fct: DataFrame) -> DataFrame:
    """Tour-level matches played to the end. An unknown score counts as not played to the end."""
    return fct.where(F.col("tourney_level").isin(*TOUR_LEVELS) & ~F.col("is_incomplete"))


def slam_title_rows(fct: DataFrame) -> DataFrame:
    """Won slam finals, retirements included."""
    return fct.where(F.col("is_title") & F.col("is_grand_slam"))


def mart_no1_weeks(rankings: DataFrame, dim: DataFrame) -> DataFrame:
    """Every weekly snapshot at number 1."""
    known = dim.select("player_id", "display_name", "date_of_birth")
    return rankings.where(F.col("ranking") == 1).join(known, "player_id").select(
        "ranking_date",
        "player_id",
        "display_name",
        years_between("date_of_birth", "ranking_date").alias("age_at_ranking"),
    )


def mart_slam_titles(fct: DataFrame, dim: DataFrame) -> DataFrame:
    """Every slam title with the champion's age. Champions missing from the master drop out."""
    known = dim.select("player_id", "display_name", "cohort")
    return slam_title_rows(fct).join(known, "player_id").select(
        "tourney_date",
        F.year("tourney_date").alias("season"),
        "tourney_name",
        "surface",
        "player_id",
        "display_name",
        "cohort",
        half_away_round("age_at_match", 2).alias("age_at_title"),
    )


def career_tallies(
    fct: DataFrame, dim: DataFrame, roster_rows: int, more: Sequence[str] = ()
) -> DataFrame:
    """Counted matches of focus players added up per player and exact age, and by the columns ``more``.

    Tallies add up: those of some seasons and those of the others are together those of all. So a stored
    career is continued by the tallies of the seasons that changed, without reading the others.
    """
    focus = dim.where("is_focus_player").select("player_id")
    won, top10, title = F.col("is_win"), F.col("vs_top10"), F.col("is_title")
    return (
        counted_matches(fct)
        .join(small_side(focus, roster_rows), "player_id", "left_semi")
        .groupBy("player_id", "age_at_match", *more)
        .agg(
            F.count("*").alias("matches"),
            F.count_if(won).alias("wins"),
            F.count_if(top10).alias("matches_vs_top10"),
            F.count_if(top10 & won).alias("wins_vs_top10"),
            F.count_if(title).alias("titles"),
            F.count_if(title & F.col("is_grand_slam")).alias("slam_titles"),
        )
    )


def slam_wins(fct: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Won slam matches: all that the slam marts need of the fact."""
    return fct.where(F.col("is_win") & F.col("is_grand_slam")).select(*SLAM_COLUMNS, *more)


def meetings(fct: DataFrame, dim: DataFrame, roster_rows: int, more: Sequence[str] = ()) -> DataFrame:
    """Counted matches of focus players against established ones: all that the head-to-heads need of the fact."""
    focus = dim.where("is_focus_player").select("player_id")
    established = dim.where(F.col("cohort") == ESTABLISHED)
    return (
        counted_matches(fct)
        .join(small_side(focus, roster_rows), "player_id", "left_semi")
        .join(small_side(as_role(established, {"opponent_id": "player_id"}), roster_rows), "opponent_id", "left_semi")
        .select(*MEETING_COLUMNS, *more)
    )


def mart_age_curves(
    tallies: DataFrame, dim: DataFrame, no1_weeks: DataFrame, roster_rows: int
) -> DataFrame:
    """Focus players per year of age, with running totals, from their ``career_tallies``.

    Weeks at number 1 attach to ages that have a counted match; the others drop out.
    """
    focus = dim.where("is_focus_player").select(
        "player_id", "display_name", "cohort", "colour_slot"
    )
    by_age = (
        tallies.join(small_side(focus, roster_rows), "player_id")
        .groupBy(*focus.columns, age_year("age_at_match").alias("age_year"))
        .agg(*[F.sum(name).alias(name) for name in TALLIES])
    )
    weeks = (
        no1_weeks.join(small_side(focus.select("player_id"), roster_rows), "player_id", "left_semi")
        .groupBy("player_id", age_year("age_at_ranking").alias("age_year"))
        .agg(F.count("*").alias("weeks_at_no1"))
    )
    curves = (
        by_age.join(weeks, ["player_id", "age_year"], "left")
        .fillna(0, ["weeks_at_no1"])
        .select(
            *by_age.columns,
            ratio("wins", "matches", 4).alias("win_pct"),
            ratio("wins_vs_top10", "matches_vs_top10", 4).alias("win_pct_vs_top10"),
            "weeks_at_no1",
        )
    )
    return running_totals(
        curves,
        ["player_id"],
        [F.col("age_year").asc_nulls_last()],
        {
            "cum_titles": F.col("titles"),
            "cum_slam_titles": F.col("slam_titles"),
            "cum_weeks_at_no1": F.col("weeks_at_no1"),
        },
    )


def pace_order() -> list[Column]:
    return [
        F.asc_nulls_last("compared_at_age_of"),
        F.desc_nulls_last("cohort"),
        F.desc_nulls_last("slam_titles"),
    ]


def mart_pace_comparison(
    tallies: DataFrame, cutoff: Column, dim: DataFrame, no1_weeks: DataFrame, roster_rows: int
) -> DataFrame:
    """What each newcomer has won, and what the established players had at exactly that age.

    ``tallies`` are the ``career_tallies``, ``cutoff`` is the newest day of the fact.
    """
    members = dim.where(F.col("cohort").isin(ESTABLISHED, NEWCOMERS)).select(
        "player_id",
        "display_name",
        "cohort",
        years_between("date_of_birth", cutoff).alias("current_age"),
    )
    pairs = cohort_pairs(
        small_side(members, roster_rows),
        "cohort",
        [(NEWCOMERS, ESTABLISHED)],
        anchor={
            "ng_id": "player_id",
            "compared_at_age_of": "display_name",
            "current_age": "current_age",
        },
        compared={"player_id": "player_id", "player_name": "display_name", "cohort": "cohort"},
    )
    summed = {"slam_titles": "slam_titles", "titles": "titles", "match_wins": "wins", "matches": "matches"}
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    matches = tallies.select(
        "player_id",
        F.col("age_at_match").alias("age"),
        *[F.col(tally).alias(name) for name, tally in summed.items()],
        none.alias("weeks_at_no1"),
    )
    weeks = no1_weeks.select(
        "player_id",
        F.col("age_at_ranking").alias("age"),
        *[none.alias(name) for name in summed],
        one.alias("weeks_at_no1"),
    )
    reached = counts_up_to_point(
        pairs,
        roster_rows * roster_rows,
        matches.unionByName(weeks),  # side by side: joining them would multiply the rows
        key="player_id",
        point="age",
        limit="current_age",
        amounts=[*summed, "weeks_at_no1"],
    )
    return reached.select(
        "compared_at_age_of",
        half_away_round("current_age", 1).alias("age"),
        "player_name",
        "cohort",
        "slam_titles",
        "titles",
        "match_wins",
        ratio("match_wins", "matches", 3).alias("win_pct"),
        "weeks_at_no1",
    ).orderBy(*pace_order())


def mart_big3_era_slams(fct: DataFrame, dim: DataFrame, roster_rows: int) -> DataFrame:
    """Slam titles of the era, with the established players beaten on the way."""
    established = dim.where(F.col("cohort") == ESTABLISHED).select(
        F.col("player_id").alias("opponent_id"), F.col("display_name").alias("beaten")
    )
    slam_wins = fct.where(F.col("is_win") & F.col("is_grand_slam"))
    beaten = (
        slam_wins.join(small_side(established, roster_rows), "opponent_id")
        .withColumn(
            "label", F.concat("beaten", F.lit(" ("), F.col("round_code"), F.lit(")"))
        )
        .groupBy("tourney_id", "player_id")
        .agg(
            F.count("*").alias("wins_in_run"),
            ordered_list("label", "tourney_date", "round_code", "beaten").alias("big3_beaten"),
        )
    )
    champion = as_role(
        dim,
        {"player_id": "player_id", "champion": "display_name", "champion_cohort": "cohort"},
    )
    finalist = as_role(dim, {"opponent_id": "player_id", "final_opponent": "display_name"})
    return (
        slam_title_rows(fct)
        .where(F.col("tourney_date") >= F.lit(ERA_START))
        .join(champion, "player_id")
        .join(finalist, "opponent_id")
        .join(beaten, ["tourney_id", "player_id"], "left")
        .select(
            "tourney_date",
            F.year("tourney_date").alias("season"),
            "tourney_name",
            "surface",
            "player_id",
            "champion",
            F.coalesce("champion_cohort", F.lit("Other")).alias("champion_group"),
            "final_opponent",
            F.coalesce("wins_in_run", F.lit(0)).alias("big3_wins_in_run"),
            "big3_beaten",
        )
    )


def mart_vs_big3_h2h(fct: DataFrame, dim: DataFrame, roster_rows: int) -> DataFrame:
    """Meetings of the other focus players with each established player."""
    others = dim.where(F.col("is_focus_player") & (F.col("cohort") != ESTABLISHED))
    established = dim.where(F.col("cohort") == ESTABLISHED)
    won, slam = F.col("is_win"), F.col("is_grand_slam")
    final = F.col("round_code") == FINAL
    met = head_to_head(
        counted_matches(fct),
        as_role(
            others, {"player_id": "player_id", "player": "display_name", "cohort": "cohort"}
        ),
        roster_rows,
        "player_id",
        as_role(established, {"opponent_id": "player_id", "opponent": "display_name"}),
        roster_rows,
        "opponent_id",
        group=["player", "cohort", "opponent"],
        counts={
            "matches": F.lit(True),
            "wins": won,
            "slam_matches": slam,
            "slam_wins": slam & won,
            "slam_finals": slam & final,
            "slam_finals_won": slam & final & won,
        },
    )
    return met.select(
        "player",
        "cohort",
        "opponent",
        "matches",
        "wins",
        ratio("wins", "matches", 3).alias("win_pct"),
        "slam_matches",
        "slam_wins",
        "slam_finals",
        "slam_finals_won",
    )
