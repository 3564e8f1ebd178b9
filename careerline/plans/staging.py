"""Staging: typed and cleaned rows of the raw text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerline.functions import (
    blank_to_null,
    full_name,
    joined_key,
    lenient_date,
    mentions_any,
    strict_date,
    try_number,
)
from careerline.operators import keep_first

# Marks in the score of a match that was not played to the end.
INCOMPLETE_MARKS = ("RET", "W/O", "DEF")


def stg_matches(raw: DataFrame) -> DataFrame:
    """One row per match. Duplicates are left to the ``unique`` check on ``match_id``.

    Ids are tested on the raw text: a non-numeric id stays as a NULL id for the checks to find.
    """
    both_sides = raw.where(F.col("winner_id").isNotNull() & F.col("loser_id").isNotNull())
    return both_sides.select(
        joined_key("tourney_id", "match_num").alias("match_id"),
        "tourney_id",
        F.replace("tourney_name", F.lit("Us Open"), F.lit("US Open")).alias("tourney_name"),
        blank_to_null("surface").alias("surface"),
        F.upper("tourney_level").alias("tourney_level"),
        strict_date("tourney_date").alias("tourney_date"),
        try_number("match_num").alias("match_num"),
        F.col("round").alias("round_code"),
        try_number("best_of").alias("best_of"),
        "score",
        try_number("minutes").alias("minutes"),
        try_number("winner_id", "bigint").alias("winner_id"),
        try_number("loser_id", "bigint").alias("loser_id"),
        try_number("winner_rank").alias("winner_rank"),
        try_number("loser_rank").alias("loser_rank"),
        try_number("winner_rank_points").alias("winner_rank_points"),
        try_number("loser_rank_points").alias("loser_rank_points"),
        mentions_any("score", *INCOMPLETE_MARKS).alias("is_incomplete"),
        "_source_file",
    )


def stg_players(raw: DataFrame) -> DataFrame:
    """One row per player id. Ids that the source re-uses keep the first name.

    Equal names are told apart by the other columns, so the pick is repeatable.
    """
    typed = raw.select(
        try_number("player_id", "bigint").alias("player_id"),
        full_name("name_first", "name_last").alias("player_name"),
        blank_to_null("hand").alias("hand"),
        lenient_date(blank_to_null("dob")).alias("date_of_birth"),
        blank_to_null("ioc").alias("country_code"),
        try_number("height").alias("height_cm"),
    ).where(F.col("player_id").isNotNull())
    tie_breaks = ("player_name", "date_of_birth", "country_code", "hand", "height_cm")
    return keep_first(typed, ["player_id"], [F.col(c).asc_nulls_last() for c in tie_breaks])


def typed_rankings(raw: DataFrame, *more: str) -> DataFrame:
    """Ranking rows as typed, and the columns ``more`` as they are."""
    return raw.select(
        strict_date("ranking_date").alias("ranking_date"),
        try_number("rank").alias("ranking"),
        try_number("player", "bigint").alias("player_id"),
        try_number("points").alias("ranking_points"),
        *more,
    ).where(F.col("player_id").isNotNull() & F.col("ranking").isNotNull())


def best_rankings(typed: DataFrame) -> DataFrame:
    """One row per player and week: the best rank, then the most points.

    Neighbouring files repeat weeks, and now and then with another rank for the same player.
    """
    order = [F.col("ranking").asc_nulls_last(), F.col("ranking_points").desc_nulls_last()]
    return keep_first(typed, ["ranking_date", "player_id"], order)


def stg_rankings(raw: DataFrame) -> DataFrame:
    """One row per player and week of the raw rankings."""
    return best_rankings(typed_rankings(raw))
