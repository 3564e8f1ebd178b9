"""The models and marts over the derived raw tables, built on demand.

As in the full run, the raw layer and the models others build on are stored tables: ``stored``
writes one the first time it is needed, into the shared folder of the session. The models
themselves (the plain attributes) are lazy frames over them.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerline.plans import marts, staging
from careerline.sources import seeds
from careerline.sources.warehouse import Warehouse
from registry import raw_tables


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where all runs in one place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/careerline-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="careerline-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


class Feed:
    """The derived feed of one session and one set of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._given: dict[str, DataFrame] = {}

    @cached_property
    def folder(self) -> str:
        return shared_folder(self.spark)

    @cached_property
    def warehouse(self) -> Warehouse:
        return Warehouse(self.spark, f"{self.folder}/tables")

    def given(self, table: str) -> DataFrame:
        if table not in self._given:
            self._given[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._given[table]

    def stored(self, name: str) -> DataFrame:
        return self.warehouse.read(self.stored_table(name))

    def stored_table(self, name: str) -> str:
        table = f"stored/{name}"
        if not self.warehouse.exists(table):
            self.warehouse.replace(table, getattr(self, name))
        return table

    def keep(self, frame: DataFrame) -> DataFrame:
        """``frame`` as a stored table of its own."""
        return self.warehouse.replace(f"kept/t{uuid.uuid4().hex}", frame)

    def _derived(self, text: str, *tables: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.given(t) for t in tables})

    @cached_property
    def raw_matches(self) -> DataFrame:
        return self._derived(raw_tables.MATCHES, "orders")

    @cached_property
    def raw_players(self) -> DataFrame:
        return self._derived(raw_tables.PLAYERS, "customer", "supplier", "nation")

    @cached_property
    def raw_rankings(self) -> DataFrame:
        return self._derived(raw_tables.RANKINGS, "orders")

    @cached_property
    def roster(self) -> seeds.Seed:
        return seeds.literal_seed(self.spark, raw_tables.ROSTER, seeds.ROSTER_SCHEMA)

    @cached_property
    def levels(self) -> seeds.Seed:
        return seeds.tourney_levels(self.spark)

    @cached_property
    def stg_matches(self) -> DataFrame:
        return staging.stg_matches(self.stored("raw_matches"))

    @cached_property
    def stg_players(self) -> DataFrame:
        return staging.stg_players(self.stored("raw_players"))

    @cached_property
    def stg_rankings(self) -> DataFrame:
        return staging.stg_rankings(self.stored("raw_rankings"))

    @cached_property
    def int_player_matches(self) -> DataFrame:
        return marts.int_player_matches(
            self.stored("stg_matches"), self.stored("stg_players"), self.levels
        )

    @cached_property
    def dim_players(self) -> DataFrame:
        return marts.dim_players(self.stored("stg_players"), self.roster)

    @property
    def fct_player_matches(self) -> DataFrame:
        """The fact after a first build."""
        return self.stored("int_player_matches")

    @cached_property
    def career_tallies(self) -> DataFrame:
        return marts.career_tallies(self.fct_player_matches, self.stored("dim_players"), self.roster.rows)

    @cached_property
    def slam_wins(self) -> DataFrame:
        return marts.slam_wins(self.fct_player_matches)

    @cached_property
    def meetings(self) -> DataFrame:
        return marts.meetings(self.fct_player_matches, self.stored("dim_players"), self.roster.rows)

    @cached_property
    def mart_no1_weeks(self) -> DataFrame:
        return marts.mart_no1_weeks(self.stored("stg_rankings"), self.stored("dim_players"))

    @cached_property
    def mart_slam_titles(self) -> DataFrame:
        return marts.mart_slam_titles(self.stored("slam_wins"), self.stored("dim_players"))

    @cached_property
    def mart_age_curves(self) -> DataFrame:
        return marts.mart_age_curves(
            self.stored("career_tallies"),
            self.stored("dim_players"),
            self.stored("mart_no1_weeks"),
            self.roster.rows,
        )

    @cached_property
    def mart_pace_comparison(self) -> DataFrame:
        return marts.mart_pace_comparison(
            self.stored("career_tallies"),
            self.fct_player_matches.agg(F.max("tourney_date")).scalar(),
            self.stored("dim_players"),
            self.stored("mart_no1_weeks"),
            self.roster.rows,
        )

    @cached_property
    def mart_big3_era_slams(self) -> DataFrame:
        return marts.mart_big3_era_slams(
            self.stored("slam_wins"), self.stored("dim_players"), self.roster.rows
        )

    @cached_property
    def mart_vs_big3_h2h(self) -> DataFrame:
        return marts.mart_vs_big3_h2h(
            self.stored("meetings"), self.stored("dim_players"), self.roster.rows
        )


@lru_cache(maxsize=4)
def feed_for(spark: SparkSession, sf_dir: str) -> Feed:
    """The feed of a session, so that its queries share the stored tables."""
    return Feed(spark, sf_dir)
