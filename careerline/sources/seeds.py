"""Typed lookup tables: tournament levels and the roster of focus players."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerline.operators.local import local_frame

LEVEL_SCHEMA = "tourney_level string, level_name string, is_grand_slam boolean"
ROSTER_SCHEMA = "player_id long, display_name string, cohort string, colour_slot int"

# Tournament level codes.
TOURNEY_LEVELS = [
    ("G", "Grand Slam", True),
    ("M", "Masters 1000", False),
    ("F", "Tour Finals", False),
    ("A", "ATP Tour (250/500)", False),
    ("D", "Davis Cup", False),
    ("O", "Olympics", False),
    ("C", "Challenger", False),
    ("S", "Satellite/ITF", False),
    ("E", "Exhibition", False),
]

# Focus players, their cohort and colour slot.
FOCUS_PLAYERS = [
    (103819, "Federer", "Big 3", 1),
    (104745, "Nadal", "Big 3", 2),
    (104925, "Djokovic", "Big 3", 3),
    (207989, "Alcaraz", "New generation", 4),
    (206173, "Sinner", "New generation", 5),
    (104918, "Murray", "Big 3 era challengers", 6),
    (104527, "Wawrinka", "Big 3 era challengers", 7),
]


@dataclass(frozen=True)
class Seed:
    """A lookup table with a known upper bound on its rows (used to decide on broadcasts)."""

    frame: DataFrame
    rows: int


def literal_seed(spark: SparkSession, rows: list[tuple], schema: str) -> Seed:
    return Seed(local_frame(spark, rows, schema), len(rows))


def csv_seed(spark: SparkSession, path: str, schema: str) -> Seed:
    """A seed kept as a CSV file with a header; its size is counted, not assumed."""
    frame = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return Seed(frame, frame.agg(F.count("*")).first()[0])


def tourney_levels(spark: SparkSession) -> Seed:
    return literal_seed(spark, TOURNEY_LEVELS, LEVEL_SCHEMA)


def focus_players(spark: SparkSession) -> Seed:
    return literal_seed(spark, FOCUS_PLAYERS, ROSTER_SCHEMA)
