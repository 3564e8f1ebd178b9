"""Report queries over the marts. Only marts and the newest fact date are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.operators import best_per_group, last_per_group
from careerline.plans.marts import ESTABLISHED, pace_order

CHALLENGERS = "Big 3 era challengers"
OTHER = "Other"

# The plotted measures, and for rates the column with their number of matches.
METRICS = {
    "cum_slam_titles": None,
    "win_pct": "matches",
    "win_pct_vs_top10": "matches_vs_top10",
    "cum_weeks_at_no1": None,
}
SCREEN_MIN_MATCHES = 5
EXPORT_MIN_MATCHES = 10

# Texts next to the figures, and the date format.
HEADLINE_TEXT = "%s: Grand Slams at %.1f"
DELTA_TEXT = "%+d vs %s at the same age"
VIA_TEXT = "%d  (%d beating a Big 3 player)"
FINALS_TEXT = "won %d of %d"
DAY_FORMAT = "dd MMM yyyy"

# Column titles of the tables.
SAME_AGE_TITLES = {
    "player_name": "Player",
    "slam_titles": "Slams",
    "titles": "Titles",
    "match_wins": "Wins",
    "win_pct": "Win %",
    "weeks_at_no1": "Weeks at No. 1",
}
HEAD_TO_HEAD_TITLES = {
    "player": "Player",
    "opponent": "Opponent",
    "matches": "Matches",
    "wins": "Wins",
    "win_pct": "Win %",
    "slam_finals": "Slam finals",
    "slam_finals_won": "Slam finals won",
}
SLAM_TITLES = {
    "tourney_date": "Date",
    "tourney_name": "Tournament",
    "surface": "Surface",
    "display_name": "Champion",
    "cohort": "Group",
    "age_at_title": "Age",
}


def _titled(frame: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    return frame.select(*titles).withColumnsRenamed(dict(titles))


def _day_text(date: Column) -> Column:
    return F.date_format(date, DAY_FORMAT)


def _by_player_and_age() -> list[Column]:
    return [F.asc_nulls_last("player_id"), F.asc_nulls_last("age_year")]


def _outside(frame: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose ``column`` is not ``value``; a missing value stays in."""
    return frame.where(~F.col(column).eqNullSafe(value))


def headline(pace: DataFrame) -> DataFrame:
    """Per newcomer: own slams and the gap to the best established player at the same age."""
    own = pace.where(F.col("player_name") == F.col("compared_at_age_of")).select(
        "compared_at_age_of", "age", "slam_titles"
    )
    best = best_per_group(
        pace.where(F.col("cohort") == ESTABLISHED),
        ["compared_at_age_of"],
        [F.desc_nulls_last("slam_titles"), F.asc_nulls_last("player_name")],
    ).select(
        "compared_at_age_of",
        F.col("player_name").alias("best_player"),
        F.col("slam_titles").alias("best_slam_titles"),
    )
    gap = F.col("slam_titles") - F.col("best_slam_titles")
    return own.join(best, "compared_at_age_of").select(
        "compared_at_age_of",
        F.format_string(HEADLINE_TEXT, "compared_at_age_of", "age").alias("label"),
        "slam_titles",
        "best_player",
        "best_slam_titles",
        F.format_string(DELTA_TEXT, gap, "best_player").alias("delta"),
    )


def anchor_count(pace: DataFrame) -> DataFrame:
    """How many newcomers are compared."""
    return pace.agg(F.countDistinct("compared_at_age_of").alias("anchors"))


def same_age_table(pace: DataFrame, anchor: str | None = None) -> DataFrame:
    """The comparison table, of one newcomer or of all."""
    if anchor is not None:
        pace = pace.where(F.col("compared_at_age_of") == anchor)
    ordered = pace.orderBy(*pace_order(), F.asc_nulls_last("player_name"))
    titled = ordered.select("compared_at_age_of", *SAME_AGE_TITLES)
    return titled.withColumnsRenamed(SAME_AGE_TITLES)


def metric_series(
    curves: DataFrame,
    metric: str,
    min_matches: int = SCREEN_MIN_MATCHES,
    players: Sequence[str] | None = None,
    without_cohort: str | None = None,
) -> DataFrame:
    """One measure by age. Rates need ``min_matches`` matches behind them.

    ``without_cohort`` applies to rates only, where seven lines get noisy.
    """
    sample = METRICS[metric]
    if players is not None:
        curves = curves.where(F.col("display_name").isin(*players))
    if sample is not None:
        curves = curves.where(F.col(sample) >= min_matches)
        if without_cohort is not None:
            curves = _outside(curves, "cohort", without_cohort)
    return (
        curves.dropna(subset=[metric])
        .select(
            "player_id",
            "display_name",
            "age_year",
            F.col(metric).cast("double").alias("value"),
            "matches",
            "wins",
            "titles",
            "slam_titles",
        )
        .orderBy(*_by_player_and_age())
    )


def exported_series(curves: DataFrame, metric: str) -> DataFrame:
    """The series as printed: stricter sample, challengers left out of rates."""
    return metric_series(curves, metric, EXPORT_MIN_MATCHES, without_cohort=CHALLENGERS)


def line_ends(series: DataFrame) -> DataFrame:
    """Where each line ends: the value at the last age."""
    return last_per_group(series, ["display_name"], ["age_year"], ["age_year", "value"])


def curve_table(curves: DataFrame, players: Sequence[str] | None = None) -> DataFrame:
    """The age curves of the picked players."""
    if players is not None:
        curves = curves.where(F.col("display_name").isin(*players))
    return curves.orderBy(*_by_player_and_age())


def era_split(era: DataFrame) -> DataFrame:
    """Slams of the era: all, won by the established players, won by the others."""
    established = F.col("champion_group") == ESTABLISHED
    return era.agg(
        F.count("*").alias("all_titles"),
        F.count_if(established).alias("big3_titles"),
        F.count_if(~F.col("champion_group").eqNullSafe(ESTABLISHED)).alias("other_titles"),
    )


def other_champions(era: DataFrame) -> DataFrame:
    """Champions from outside: titles, and how many came through an established player."""
    through = F.count_if(F.col("big3_wins_in_run") > 0)
    titles = F.count("*")
    return (
        _outside(era, "champion_group", ESTABLISHED)
        .groupBy("champion")
        .agg(
            titles.alias("titles"),
            through.alias("via_big3"),
            (titles - through).alias("without_big3"),
        )
        .withColumn("label", F.format_string(VIA_TEXT, "titles", "via_big3"))
        .orderBy("titles", "via_big3", "champion")
    )


def other_titles(era: DataFrame) -> DataFrame:
    """Every title from outside, oldest first, with the established players beaten."""
    ordered = _outside(era, "champion_group", ESTABLISHED).orderBy(
        F.asc_nulls_last("tourney_date")
    )
    return ordered.select(
        "season", "tourney_name", "champion", "final_opponent", "big3_beaten"
    )


def challenger_finals(h2h: DataFrame) -> DataFrame:
    """The challengers' slam finals against the established players."""
    return (
        h2h.where(F.col("cohort") == CHALLENGERS)
        .groupBy("player")
        .agg(
            F.sum("slam_finals").alias("slam_finals"),
            F.sum("slam_finals_won").alias("slam_finals_won"),
        )
        .withColumn("slam_finals_lost", F.col("slam_finals") - F.col("slam_finals_won"))
        .withColumn("label", F.format_string(FINALS_TEXT, "slam_finals_won", "slam_finals"))
        .orderBy("slam_finals", "player")
    )


def head_to_head_table(h2h: DataFrame) -> DataFrame:
    ordered = h2h.orderBy(*[F.asc_nulls_last(c) for c in ("cohort", "player", "opponent")])
    return _titled(ordered, HEAD_TO_HEAD_TITLES)


def all_titles(slams: DataFrame) -> DataFrame:
    """Every slam title, newest first."""
    grouped = (
        slams.fillna({"cohort": OTHER})
        .withColumn("tourney_date", F.col("tourney_date").cast("date"))
        .orderBy(F.desc_nulls_last("tourney_date"))
    )
    return _titled(grouped, SLAM_TITLES)


def cutoff_caption(slams: DataFrame, fct: DataFrame) -> DataFrame:
    """Slams of the established players, and the day the data ends."""
    newest = fct.agg(F.max("tourney_date")).scalar()
    total = slams.agg(F.count_if(F.col("cohort") == ESTABLISHED).alias("big3_slams"))
    return total.select("big3_slams", _day_text(newest).alias("data_to"))


def focus_slots(curves: DataFrame) -> DataFrame:
    """Focus players with their fixed slot."""
    return curves.select("display_name", "colour_slot").distinct()


def pace_bars(pace: DataFrame) -> DataFrame:
    """Slams by the same age, per newcomer, smallest first."""
    return pace.select("compared_at_age_of", "age", "player_name", "slam_titles").orderBy(
        "compared_at_age_of", "slam_titles", "player_name"
    )


def all_reports(marts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every report over a full set of marts."""
    curves, pace = marts["mart_age_curves"], marts["mart_pace_comparison"]
    era, h2h = marts["mart_big3_era_slams"], marts["mart_vs_big3_h2h"]
    slams, fct = marts["mart_slam_titles"], marts["fct_player_matches"]
    reports = {
        "headline": headline(pace),
        "anchor_count": anchor_count(pace),
        "same_age_table": same_age_table(pace),
        "pace_bars": pace_bars(pace),
        "curve_table": curve_table(curves),
        "focus_slots": focus_slots(curves),
        "era_split": era_split(era),
        "other_champions": other_champions(era),
        "other_titles": other_titles(era),
        "challenger_finals": challenger_finals(h2h),
        "head_to_head_table": head_to_head_table(h2h),
        "all_titles": all_titles(slams),
        "cutoff_caption": cutoff_caption(slams, fct),
    }
    for metric in METRICS:
        exported = exported_series(curves, metric)
        reports[f"series_{metric}"] = metric_series(curves, metric)
        reports[f"exported_series_{metric}"] = exported
        reports[f"line_ends_{metric}"] = line_ends(exported)
    return reports
