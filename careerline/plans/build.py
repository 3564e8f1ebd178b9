"""The full run: load, build layer by layer with gates in between, report."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerline.operators import apply_window, local_frame
from careerline.plans import checks, marts, reports, staging
from careerline.sources import seeds
from careerline.sources.ingest import ingest, raw_table
from careerline.sources.warehouse import Warehouse, side_by_side

log = logging.getLogger(__name__)

FACT = "marts/fct_player_matches"
FACT_KEY = "player_match_id"
FACT_DATE = "tourney_date"
TRAILING_DAYS = 365
NO_SEASON = -1
#: The season of every key of the fact, and the rows that the last refresh brought.
FACT_KEYS = "marts/fct_player_matches_keys"
FACT_WINDOW = "marts/fct_player_matches_window"
#: Ranking rows by source file, before the best of each player and week is picked.
TYPED_RANKINGS = "staging/typed_rankings"
#: What the marts need of the fact, in parts by its seasons: a changed season has its part made again.
CAREERS = "marts/career_tallies"
SLAM_WINS = "marts/slam_wins"
MEETINGS = "marts/meetings"

#: What the stored tables were built from, published together with them.
BUILT = "marts/built_from"
#: Another name here has everything built again by changed model rules.
RULES = "models-3"
ENTITIES = ("matches", "players", "rankings")

# Layer of every stored table.
STORED = {
    "stg_matches": "staging",
    "stg_players": "staging",
    "stg_rankings": "staging",
    "int_player_matches": "intermediate",
    "dim_players": "marts",
    "fct_player_matches": "marts",
    "mart_no1_weeks": "marts",
    "mart_slam_titles": "marts",
    "mart_age_curves": "marts",
    "mart_pace_comparison": "marts",
    "mart_big3_era_slams": "marts",
    "mart_vs_big3_h2h": "marts",
}


def stored_name(name: str) -> str:
    return f"{STORED[name]}/{name}"


def _season(date: str) -> Column:
    return F.coalesce(F.year(date), F.lit(NO_SEASON)).cast("string")


def _seasons(frame: DataFrame, date: str = FACT_DATE) -> set[str]:
    """The seasons that occur: as many rows as there are calendar years."""
    return {r[0] for r in frame.select(_season(date)).distinct().collect()}


def newest_day(warehouse: Warehouse) -> Column:
    """The newest day of the stored fact, read from the footers of its last season alone; NULL if it has no day."""
    dated = [int(season) for season in warehouse.parts(FACT) if season != str(NO_SEASON)]
    last = warehouse.read_footers(FACT, [str(max(dated))]).agg(F.max(FACT_DATE)).first()[0] if dated else None
    return F.lit(last).cast("date")


def store_by_season(warehouse: Warehouse, table: str, seasons: Iterable[str], model: Callable[..., DataFrame]) -> None:
    """Make the parts ``seasons`` of ``table`` again from the fact's rows of these seasons; no other season is read."""
    seasons = sorted(seasons)
    fact = warehouse.read(FACT, seasons).withColumn("_season", _season(FACT_DATE))
    warehouse.replace_parts(table, model(fact, more=["_season"]), F.col("_season"), seasons, rebalance=True, drop=["_season"])


def refresh_fact(
    warehouse: Warehouse,
    source: DataFrame,
    full_refresh: bool = False,
    watched: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Bring the stored fact up to date with ``source``; reads and rewrites only the seasons concerned.

    These are the seasons of the trailing window and those that hold an older row with a key of
    the window: a corrected date can move a row from one season to another. A side table of key hashes tells
    them (two keys with one hash cost a season that is rewritten as it was), so no other season is opened.
    ``watched`` wraps the rows that are written.
    """
    hashed = F.xxhash64(FACT_KEY).alias("key")

    def store(rows: DataFrame, concerned: set[str]) -> None:
        warehouse.replace_parts(FACT, watched(rows), _season(FACT_DATE), concerned, rebalance=True)
        keys = warehouse.read(FACT, concerned).select(hashed, _season(FACT_DATE).alias("season"))
        warehouse.replace_parts(FACT_KEYS, keys, F.col("season"), concerned)

    if full_refresh or not warehouse.exists(FACT):
        store(source, _seasons(source) | set(warehouse.parts(FACT)))
        return warehouse.read(FACT)
    since = F.date_sub(newest_day(warehouse), TRAILING_DAYS)  # a literal skips row groups of the scan
    window = warehouse.replace(FACT_WINDOW, source.where(F.col(FACT_DATE) >= since))
    known = warehouse.read(FACT_KEYS).join(window.select(hashed), "key", "left_semi")
    concerned = _seasons(window) | {r["season"] for r in known.select("season").distinct().collect()}
    if concerned:
        store(apply_window(warehouse.read(FACT, concerned), window, FACT_KEY), concerned)
    return warehouse.read(FACT)


def _inputs(warehouse: Warehouse, roster: seeds.Seed, levels: seeds.Seed) -> dict[str, str]:
    """What the models read, each with a text that changes when it does: one entry per source file, the rules and the seeds."""
    found = {f"raw_{e}/{part}": str(folder) for e in ENTITIES for part, folder in warehouse.snapshot(raw_table(e))}
    for name, seed in (("roster", roster), ("levels", levels)):
        rows = sorted(str(r.asDict()) for r in seed.frame.collect())  # seeds are small by what they are
        found[name] = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return {**found, "rules": RULES}


@dataclass(frozen=True)
class Changes:
    """What differs from the inputs of the last build."""

    matches: list[str]
    players: list[str]
    rankings: list[str]
    roster: bool
    levels: bool

    def __bool__(self) -> bool:
        return any((self.matches, self.players, self.rankings, self.roster, self.levels))


def _changes(warehouse: Warehouse, inputs: dict[str, str], rebuild: bool) -> Changes:
    """Source files by entity, and seeds, that are new or changed; all of them without a usable last build."""
    known: dict[str, str] = {}
    if not rebuild and all(map(warehouse.exists, [BUILT, TYPED_RANKINGS, FACT_KEYS, CAREERS, SLAM_WINS, MEETINGS, *map(stored_name, STORED)])):
        known = {r["input"]: r["state"] for r in warehouse.read(BUILT).collect()}  # one row per source file
        known = known if known.get("rules") == RULES else {}
    new = {name for name, state in inputs.items() if known.get(name) != state}
    files = {e: sorted(n.split("/", 1)[1] for n in new if n.startswith(f"raw_{e}/")) for e in ENTITIES}
    return Changes(**files, roster="roster" in new, levels="levels" in new)


def _store_rankings(warehouse: Warehouse, files: list[str], watched: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Type the rows of ``files`` and pick the best again in the years that they have, or had before; returns these years' rows."""
    name, day = stored_name("stg_rankings"), F.col("ranking_date")
    years = _seasons(warehouse.read(TYPED_RANKINGS, files), "ranking_date") if warehouse.exists(TYPED_RANKINGS) else set()
    raw = warehouse.read(raw_table("rankings"), files)
    typed = staging.typed_rankings(raw, "_source_file")
    warehouse.replace_parts(TYPED_RANKINGS, typed, F.col("_source_file"), files, drop=["_source_file"])
    years |= _seasons(warehouse.read(TYPED_RANKINGS, files), "ranking_date")
    dated = sorted(int(y) for y in years if int(y) != NO_SEASON)
    near = day.isNull()
    if dated:  # a range of days is pushed down to the scan, a year is not
        near |= day.between(F.make_date(F.lit(dated[0]), F.lit(1), F.lit(1)), F.make_date(F.lit(dated[-1]), F.lit(12), F.lit(31)))
    concerned = warehouse.read(TYPED_RANKINGS).where(near & _season("ranking_date").isin(*years))
    warehouse.replace_parts(name, watched(staging.best_rankings(concerned)), _season("ranking_date"), years, rebalance=True)
    return warehouse.read(name, years)


def build(
    warehouse: Warehouse,
    full_refresh: bool = False,
    roster: seeds.Seed | None = None,
    levels: seeds.Seed | None = None,
    rebuild: bool = False,
) -> dict[str, DataFrame]:
    """All models over the raw tables; every layer is checked before the next one is built.

    Only what depends on a source file or seed that has changed since the last build is built and checked again: matches
    are typed and turned into player rows file by file, rankings typed by file and picked by year, the fact is refreshed, and what
    the marts need of it is made again for the seasons that the refresh rewrote. Checks look at the rows that came in
    (``checks.Delta``). ``rebuild`` takes all files as changed, ``full_refresh``
    also replaces the whole fact. The new tables are published together at the end: a failing check leaves the old ones.
    """
    spark = warehouse.spark
    roster = roster or seeds.focus_players(spark)
    levels = levels or seeds.tourney_levels(spark)
    inputs = _inputs(warehouse, roster, levels)
    changes = _changes(warehouse, inputs, rebuild or full_refresh)
    if not changes:
        tables = stored_marts(warehouse)
        for name, frame in tables.items():
            frame.createOrReplaceTempView(name)
        return {"tourney_levels": levels.frame, **tables}

    tables = {"tourney_levels": levels.frame}
    deltas: dict[str, checks.Delta] = {}
    watches = {name: checks.Watch(name) for name in STORED}
    fact_before = dict(warehouse.snapshot(FACT))
    touched: set[str] = {"tourney_levels"} if changes.levels else set()

    def store(steps: dict[str, tuple[object, Callable[[], object]]]) -> None:
        """Run the steps that there is a reason for, side by side, and register their tables."""
        due = {name: step for name, (reason, step) in steps.items() if reason}
        side_by_side(list(due.values()))
        touched.update(due)
        for name in steps:
            tables[name] = warehouse.read(stored_name(name))
            tables[name].createOrReplaceTempView(name)

    def whole(name: str, model: Callable[[], DataFrame]) -> Callable[[], object]:
        return lambda: warehouse.replace(stored_name(name), watches[name].over(model()))

    def gate(wanted: Iterable[checks.Check]) -> None:
        concerned = [c for c in wanted if c.table in touched or c.options.get("parent") in touched]
        if concerned:
            settled = {n for table in {c.table for c in concerned} for n in watches[table].settled()}
            checks.gate(tables, concerned, deltas, settled)

    def store_matches() -> None:
        typed = staging.stg_matches(warehouse.read(raw_table("matches"), changes.matches))
        known = set(warehouse.parts(stored_name("stg_matches"))) - set(changes.matches)
        typed = watches["stg_matches"].over(typed)
        counted = warehouse.replace_parts(stored_name("stg_matches"), typed, F.col("_source_file"), changes.matches)
        if known and not changes.levels:
            came = warehouse.read(stored_name("stg_matches"), changes.matches)
            deltas["stg_matches"] = checks.Delta(came, sum(counted.values()))

    def store_rankings() -> None:
        came = _store_rankings(warehouse, changes.rankings, watches["stg_rankings"].over)
        deltas["stg_rankings"] = checks.Delta(came)  # a player's week lies in one year

    def store_player_matches() -> None:
        every = changes.players or changes.levels
        files = [p for p, _ in warehouse.snapshot(stored_name("stg_matches"))] if every else changes.matches
        matches = warehouse.read(stored_name("stg_matches"), files)
        rows = marts.int_player_matches(matches, tables["stg_players"], levels, more=["_source_file"])
        rows = watches["int_player_matches"].over(rows)
        warehouse.replace_parts(stored_name("int_player_matches"), rows, F.col("_source_file"), files, drop=["_source_file"])
        if not every:  # a match stands in one file, as the gate before has shown, and its key is in its rows' keys
            came = warehouse.read(stored_name("int_player_matches"), files)
            deltas["int_player_matches"] = checks.Delta(came)

    def store_fact() -> None:
        refresh_fact(warehouse, tables["int_player_matches"], full_refresh, watches["fct_player_matches"].over)
        if not full_refresh:  # the refresh opens all seasons that hold a key of its window
            deltas["fct_player_matches"] = checks.Delta(warehouse.read(FACT, rewritten()))

    def rewritten() -> list[str]:
        """The seasons that this build wrote."""
        return sorted(p for p, folder in warehouse.snapshot(FACT) if p not in fact_before or fact_before[p] != folder)

    with warehouse.publishing():
        raw_players = partial(warehouse.read, raw_table("players"))
        store({
            "stg_matches": (changes.matches, store_matches),
            "stg_players": (changes.players, whole("stg_players", lambda: staging.stg_players(raw_players()))),
            "stg_rankings": (changes.rankings, store_rankings),
        })
        gate(checks.STAGING)

        store({
            "int_player_matches": (changes.matches or changes.players or changes.levels, store_player_matches),
            "dim_players": (changes.players or changes.roster, whole("dim_players", lambda: marts.dim_players(tables["stg_players"], roster))),
        })
        gate([*checks.INTERMEDIATE, *checks.DIMENSION])

        facts_due = full_refresh or "int_player_matches" in touched
        store({"fct_player_matches": (facts_due, store_fact)})
        gate(checks.FACT)

        dim, rows = tables["dim_players"], roster.rows
        seasons, members = rewritten(), "dim_players" in touched or changes.roster
        every_season = [p for p, _ in warehouse.snapshot(FACT)]
        steps = {
            CAREERS: (members, lambda fact, more: marts.career_tallies(fact, dim, rows, more)),
            MEETINGS: (members, lambda fact, more: marts.meetings(fact, dim, rows, more)),
            SLAM_WINS: (False, marts.slam_wins),
        }
        due = {t: every_season if of_all or not warehouse.exists(t) else seasons for t, (of_all, _) in steps.items()}
        side_by_side([partial(store_by_season, warehouse, t, due[t], model) for t, (_, model) in steps.items() if due[t] or not warehouse.exists(t)])
        careers, slams, met = (warehouse.read(t) for t in (CAREERS, SLAM_WINS, MEETINGS))

        played = bool(touched & {"fct_player_matches", "dim_players"}) or changes.roster
        weeks = bool(touched & {"stg_rankings", "dim_players"})
        store({
            "mart_no1_weeks": (weeks, whole("mart_no1_weeks", lambda: marts.mart_no1_weeks(tables["stg_rankings"], dim))),
            "mart_slam_titles": (played, whole("mart_slam_titles", lambda: marts.mart_slam_titles(slams, dim))),
            "mart_big3_era_slams": (played, whole("mart_big3_era_slams", lambda: marts.mart_big3_era_slams(slams, dim, rows))),
            "mart_vs_big3_h2h": (played, whole("mart_vs_big3_h2h", lambda: marts.mart_vs_big3_h2h(met, dim, rows))),
        })
        no1, cutoff = tables["mart_no1_weeks"], newest_day(warehouse)
        store({
            "mart_age_curves": (played or weeks, whole("mart_age_curves", lambda: marts.mart_age_curves(careers, dim, no1, rows))),
            "mart_pace_comparison": (played or weeks, whole("mart_pace_comparison", lambda: marts.mart_pace_comparison(careers, cutoff, dim, no1, rows))),
        })
        gate(checks.MARTS)
        warehouse.replace(BUILT, local_frame(spark, sorted(inputs.items()), "input string, state string"))
    return tables


def stored_marts(warehouse: Warehouse) -> dict[str, DataFrame]:
    """The stored tables, for reports that run on their own."""
    return {name: warehouse.read(stored_name(name)) for name in STORED}


def full_run(
    spark: SparkSession,
    source_dir: str,
    root: str,
    min_year: int = 1990,
    full_refresh: bool = False,
    roster: seeds.Seed | None = None,
) -> dict[str, DataFrame]:
    """Load ``source_dir`` into the warehouse at ``root``, build everything, return the reports."""
    warehouse = Warehouse(spark, root)
    log.info("load: %s", ingest(warehouse, source_dir, min_year))
    build(warehouse, full_refresh, roster)
    return reports.all_reports(stored_marts(warehouse))
