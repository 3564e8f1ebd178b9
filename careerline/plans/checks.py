"""The data checks of every layer, and the gate that stops a run."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from careerline.operators import quality, small_side

log = logging.getLogger(__name__)

# Court surfaces.
SURFACES = ("Hard", "Clay", "Grass", "Carpet")


class DataCheckError(Exception):
    """A check of severity ``error`` found violations."""


#: Checks that compare rows of one key; all others look at the rows of one table one by one.
KEY_KINDS = ("unique", "one_of_each", "unique_combination")


@dataclass(frozen=True)
class Delta:
    """The rows that a table got since all its checks passed; everything else in it is as it was, or gone.

    A violation that was not there before has one of these rows, so the checks need to look at them alone, and at the rows
    that share a key with one of them. ``at_most`` is an upper bound of the rows; without it, rows of other parts
    cannot have their keys, by the way the table is made.
    """

    rows: DataFrame
    at_most: int | None = None

    def among(self, whole: DataFrame, key: Sequence[str]) -> DataFrame:
        """All rows of ``whole`` with a key of ``rows``; keys with NULL are keys."""
        if self.at_most is None:
            return self.rows
        names = [f"_key{i}" for i in range(len(key))]
        keys = small_side(self.rows.select(*[F.col(c).alias(n) for c, n in zip(key, names)]).distinct(), self.at_most)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names)])
        return whole.join(keys, same, "left_semi")


@dataclass(frozen=True)
class Check:
    """One check on one table. ``severity`` is ``error`` (stops the run) or ``warn``."""

    table: str
    kind: str
    columns: tuple[str, ...]
    severity: str = "error"
    options: Mapping[str, object] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.table}.{'+'.join(self.columns)}.{self.kind}"

    @property
    def row_condition(self) -> Column | None:
        """The condition of a violating row, for checks that look at one row at a time."""
        column = self.columns[0]
        if self.kind == "not_null":
            return F.col(column).isNull()
        if self.kind == "accepted_values":
            return quality.not_accepted(column, self.options["values"])
        return None

    def violations(self, tables: Mapping[str, DataFrame], delta: Delta | None = None) -> DataFrame:
        """The violations; with ``delta``, those among its rows and the rows with their keys."""
        frame, column = tables[self.table], self.columns[0]
        if delta is not None:
            frame = delta.among(frame, self.columns) if self.kind in KEY_KINDS else delta.rows
        if self.kind == "not_null":
            return quality.not_null(frame, column)
        if self.kind == "accepted_values":
            return quality.accepted_values(frame, column, self.options["values"])
        if self.kind == "unique":
            return quality.unique(frame, column)
        if self.kind == "unique_combination":
            return quality.unique_combination(frame, self.columns)
        if self.kind == "relationships":
            parent = tables[self.options["parent"]]
            return quality.relationships(frame, column, parent, self.options["field"])
        if self.kind == "one_of_each":
            return quality.one_of_each(frame, column, self.options["flag"])
        raise ValueError(f"unknown check kind {self.kind!r}")


def _key(table: str, column: str) -> list[Check]:
    return [Check(table, "unique", (column,)), Check(table, "not_null", (column,))]


STAGING = [
    *_key("stg_matches", "match_id"),
    Check("stg_matches", "not_null", ("tourney_date",)),
    Check("stg_matches", "not_null", ("winner_id",)),
    Check("stg_matches", "not_null", ("loser_id",)),
    Check("stg_matches", "accepted_values", ("surface",), options={"values": SURFACES}),
    Check(
        "stg_matches",
        "relationships",
        ("tourney_level",),
        options={"parent": "tourney_levels", "field": "tourney_level"},
    ),
    *_key("stg_players", "player_id"),
    Check("stg_rankings", "not_null", ("ranking_date",)),
    Check("stg_rankings", "unique_combination", ("ranking_date", "player_id")),
]

INTERMEDIATE = [
    *_key("int_player_matches", "player_match_id"),
    Check("int_player_matches", "not_null", ("player_id",)),
    Check(
        "int_player_matches",
        "relationships",
        ("player_id",),
        severity="warn",  # the player file does not reach back to everyone
        options={"parent": "stg_players", "field": "player_id"},
    ),
    Check("int_player_matches", "one_of_each", ("match_id",), options={"flag": "is_win"}),
]

DIMENSION = _key("dim_players", "player_id")
FACT = _key("fct_player_matches", "player_match_id")
MARTS = [
    Check("mart_age_curves", "unique_combination", ("player_id", "age_year")),
    Check("mart_age_curves", "not_null", ("win_pct",)),
    Check("mart_big3_era_slams", "not_null", ("champion",)),
]

ALL_CHECKS = [*STAGING, *INTERMEDIATE, *DIMENSION, *FACT, *MARTS]


def check_report(
    tables: Mapping[str, DataFrame], checks: Iterable[Check], deltas: Mapping[str, Delta] | None = None
) -> DataFrame:
    """(check_name, severity, failures) for all ``checks`` in one query.

    The row-by-row checks of a table share one scan; the grouping checks count their violations. Tables
    named in ``deltas`` are checked where they changed.
    """
    checks, deltas = list(checks), deltas or {}
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        by_row = [c for c in checks if c.table == table and c.row_condition is not None]
        if by_row:
            frame = deltas[table].rows if table in deltas else tables[table]
            counted = frame.agg(
                F.array(
                    *[
                        F.struct(
                            F.lit(c.name).alias("check_name"),
                            F.lit(c.severity).alias("severity"),
                            F.count_if(c.row_condition).alias("failures"),
                        )
                        for c in by_row
                    ]
                ).alias("results")
            )
            parts.append(counted.select(F.inline("results")))
    for check in checks:
        if check.row_condition is None:
            failures = check.violations(tables, deltas.get(check.table)).agg(F.count("*").alias("failures"))
            parts.append(
                failures.select(
                    F.lit(check.name).alias("check_name"),
                    F.lit(check.severity).alias("severity"),
                    "failures",
                )
            )
    return reduce(DataFrame.unionByName, parts)


class Watch:
    """Counts the rows of a table that violate its row-by-row checks while they are written.

    A count of zero settles a check without a scan of its own. Any other count is taken as a reason to look at the stored rows:
    tasks that are run again after a lost executor can count twice, and Spark counts nothing over an input
    that it proves to be empty.
    """

    def __init__(self, table: str) -> None:
        self.checks = [c for c in ALL_CHECKS if c.table == table and c.row_condition is not None]
        self._seen: Observation | None = None

    def over(self, frame: DataFrame) -> DataFrame:
        """``frame``, counted by its next action, which has to be the write."""
        if not self.checks:
            return frame
        self._seen = Observation()
        return frame.observe(self._seen, *[F.count_if(c.row_condition).alias(c.name) for c in self.checks])

    def settled(self) -> set[str]:
        """Names of the checks that no written row violates."""
        if self._seen is None:
            return set()
        try:
            counts = self._seen.get
        except Py4JJavaError:  # no counts
            return set()
        return {c.name for c in self.checks if counts[c.name] == 0}


def gate(
    tables: Mapping[str, DataFrame],
    checks: Iterable[Check],
    deltas: Mapping[str, Delta] | None = None,
    settled: Iterable[str] = (),
) -> dict[str, int]:
    """Run ``checks``, but those ``settled`` by the write; raise on a failing error check, log a failing warning."""
    passed = set(settled)
    checks = list(checks)
    due = [c for c in checks if c.name not in passed]
    found = check_report(tables, due, deltas).collect() if due else []  # one row per check
    failing = [row for row in found if row["failures"]]
    for row in failing:
        log.warning("%s: %d violations (%s)", row["check_name"], row["failures"], row["severity"])
    stopping = [row["check_name"] for row in failing if row["severity"] == "error"]
    if stopping:
        raise DataCheckError(", ".join(stopping))
    failures = {row["check_name"]: row["failures"] for row in found}
    return {c.name: failures.get(c.name, 0) for c in checks}
