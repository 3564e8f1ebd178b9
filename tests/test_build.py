"""The full run on the small feed: expected marts, incremental refresh, gates."""

import datetime

import pytest
from pyspark.sql import functions as F

from careerline.plans import build as plan
from careerline.plans import checks, reports
from careerline.sources import seeds
from careerline.sources.ingest import ingest
from careerline.sources.warehouse import Warehouse
from tests import fixture_files as feed

D = datetime.date


def roster(spark, rows=feed.ROSTER):
    return seeds.literal_seed(spark, rows, seeds.ROSTER_SCHEMA)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    source = feed.write_feed(folder / "source")
    warehouse = Warehouse(spark, str(folder / "warehouse"))
    ingest(warehouse, str(source))
    plan.build(warehouse, roster=roster(spark))
    first = {n: sorted(map(repr, f.collect())) for n, f in plan.stored_marts(warehouse).items()}
    again = Warehouse(spark, str(folder / "warehouse"))
    ingest(again, str(source))
    plan.build(again, roster=roster(spark))
    return first, again


def rows(warehouse, name, *columns, order=None):
    frame = warehouse.read(plan.stored_name(name))
    if order:
        frame = frame.orderBy(*order)
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_second_build_changes_nothing(built):
    first, again = built
    for name, frame in plan.stored_marts(again).items():
        assert sorted(map(repr, frame.collect())) == first[name], name


def test_unchanged_inputs_write_nothing_and_a_rebuild_gives_the_same(spark, place):
    """A build over the inputs of the last one leaves its snapshots; another roster does not."""
    source, root = place
    names = [plan.stored_name(n) for n in plan.STORED]
    snapshots = lambda: [Warehouse(spark, root).snapshot(n) for n in names]
    before = snapshots()
    warehouse = Warehouse(spark, root)
    content = {n: sorted(map(repr, f.collect())) for n, f in plan.stored_marts(warehouse).items()}
    ingest(warehouse, str(source))
    tables = plan.build(warehouse, roster=roster(spark))
    assert tables.keys() == {"tourney_levels", *plan.STORED}
    assert spark.table("dim_players").count() == 7
    assert snapshots() == before
    plan.build(warehouse, rebuild=True, roster=roster(spark))
    assert all(old != new for old, new in zip(before, snapshots(), strict=True))
    rebuilt = plan.stored_marts(Warehouse(spark, root))
    assert {n: sorted(map(repr, f.collect())) for n, f in rebuilt.items()} == content
    plan.build(warehouse, roster=roster(spark, [r for r in feed.ROSTER if r[1] != "Pell"]))
    players = plan.stored_marts(warehouse)["mart_age_curves"].select("display_name").distinct()
    assert {r[0] for r in players.collect()} == {"Osk", "Quarn", "Rill", "Stav", "Tarn"}


def test_layer_sizes(built):
    _, warehouse = built
    sizes = {n: f.count() for n, f in plan.stored_marts(warehouse).items()}
    assert sizes == {
        "stg_matches": 9,
        "stg_players": 7,
        "stg_rankings": 6,
        "int_player_matches": 18,
        "dim_players": 7,
        "fct_player_matches": 18,
        "mart_no1_weeks": 4,
        "mart_slam_titles": 2,
        "mart_age_curves": 9,
        "mart_pace_comparison": 8,
        "mart_big3_era_slams": 2,
        "mart_vs_big3_h2h": 3,
    }


def test_dimension(built):
    _, warehouse = built
    dim = {r[0]: r[1:] for r in rows(warehouse, "dim_players", "player_id", "display_name", "cohort", "is_focus_player")}
    assert dim[feed.UMBER] == ("Ulf Umber", None, False)
    assert dim[feed.RILL] == ("Rill", "New generation", True)
    assert sum(focus for _, _, focus in dim.values()) == 6


def test_weeks_at_number_one(built):
    _, warehouse = built
    found = rows(warehouse, "mart_no1_weeks", "ranking_date", "display_name", F.round("age_at_ranking", 4), order=["ranking_date"])
    assert found == [
        (D(2007, 7, 9), "Pell", 26.8118),
        (D(2007, 7, 16), "Pell", 26.8309),
        (D(2019, 7, 8), "Rill", 22.5462),
        (D(2019, 11, 4), "Stav", 21.5852),
    ]


def test_slam_titles(built):
    _, warehouse = built
    found = rows(warehouse, "mart_slam_titles", "season", "tourney_name", "display_name", "age_at_title", order=["tourney_date"])
    assert found == [(2007, "Summit Open", "Pell", 26.79), (2019, "Summit Open", "Rill", 22.53)]


def test_age_curves(built):
    _, warehouse = built
    found = rows(
        warehouse, "mart_age_curves", "display_name", "age_year", "matches", "wins", "matches_vs_top10",
        "wins_vs_top10", "titles", "slam_titles", "win_pct", "win_pct_vs_top10", "weeks_at_no1",
        "cum_titles", "cum_slam_titles", "cum_weeks_at_no1", order=["player_id", "age_year"],
    )
    assert found == [
        ("Osk", 21, 1, 1, 0, 0, 1, 0, 1.0, None, 0, 1, 0, 0),
        ("Osk", 42, 1, 0, 1, 0, 0, 0, 0.0, 0.0, 0, 1, 0, 0),
        ("Pell", 17, 1, 0, 0, 0, 0, 0, 0.0, None, 0, 0, 0, 0),
        ("Pell", 26, 1, 1, 1, 1, 1, 1, 1.0, 1.0, 2, 1, 1, 2),
        ("Quarn", 24, 2, 1, 1, 0, 0, 0, 0.5, 0.0, 0, 0, 0, 0),
        ("Quarn", 36, 1, 0, 1, 0, 0, 0, 0.0, 0.0, 0, 0, 0, 0),
        ("Rill", 22, 3, 2, 1, 1, 1, 1, 0.6667, 1.0, 1, 1, 1, 1),
        ("Stav", 21, 1, 1, 1, 1, 1, 0, 1.0, 1.0, 1, 1, 0, 1),
        ("Tarn", 22, 1, 0, 1, 0, 0, 0, 0.0, 0.0, 0, 0, 0, 0),
    ]


def test_pace(built):
    _, warehouse = built
    found = rows(
        warehouse, "mart_pace_comparison", "compared_at_age_of", "age", "player_name", "cohort",
        "slam_titles", "titles", "match_wins", "win_pct", "weeks_at_no1",
    )
    new, old = "New generation", "Big 3"
    assert sorted(found, key=repr) == sorted(
        [
            ("Rill", 22.9, "Rill", new, 1, 1, 2, 0.667, 1),
            ("Rill", 22.9, "Osk", old, 0, 1, 1, 1.0, 0),
            ("Rill", 22.9, "Pell", old, 0, 0, 0, 0.0, 0),
            ("Rill", 22.9, "Quarn", old, 0, 0, 0, None, 0),
            ("Stav", 21.6, "Stav", new, 0, 1, 1, 1.0, 0),
            ("Stav", 21.6, "Osk", old, 0, 1, 1, 1.0, 0),
            ("Stav", 21.6, "Pell", old, 0, 0, 0, 0.0, 0),
            ("Stav", 21.6, "Quarn", old, 0, 0, 0, None, 0),
        ],
        key=repr,
    )


def test_era_slams(built):
    _, warehouse = built
    found = rows(
        warehouse, "mart_big3_era_slams", "season", "champion", "champion_group", "final_opponent",
        "big3_wins_in_run", "big3_beaten", order=["tourney_date"],
    )
    assert found == [
        (2007, "Pell", "Big 3", "Quarn", 1, "Quarn (F)"),
        (2019, "Rill", "New generation", "Osk", 2, "Osk (F), Quarn (SF)"),
    ]


def test_head_to_head(built):
    _, warehouse = built
    found = rows(
        warehouse, "mart_vs_big3_h2h", "player", "opponent", "matches", "wins", "win_pct",
        "slam_matches", "slam_wins", "slam_finals", "slam_finals_won", order=["player", "opponent"],
    )
    assert found == [
        ("Rill", "Osk", 1, 1, 1.0, 1, 1, 1, 1),
        ("Rill", "Quarn", 1, 1, 1.0, 1, 1, 0, 0),
        ("Tarn", "Quarn", 1, 0, 0.0, 1, 0, 0, 0),
    ]


def test_reports(built):
    _, warehouse = built
    found = {
        n: [tuple(r) for r in f.collect()]
        for n, f in reports.all_reports(plan.stored_marts(warehouse)).items()
    }
    assert found["headline"] == [
        ("Rill", "Rill: Grand Slams at 22.9", 1, "Osk", 0, "+1 vs Osk at the same age"),
        ("Stav", "Stav: Grand Slams at 21.6", 0, "Osk", 0, "+0 vs Osk at the same age"),
    ]
    assert found["anchor_count"] == [(2,)]
    assert found["cutoff_caption"] == [(1, "28 Oct 2019")]
    assert found["era_split"] == [(2, 1, 1)]
    assert found["other_champions"] == [("Rill", 1, 1, 0, "1  (1 beating a Big 3 player)")]
    assert [r[3] for r in found["all_titles"]] == ["Rill", "Pell"]
    assert [r[2] for r in found["other_titles"]] == ["Rill"]
    assert [r[1] for r in found["same_age_table"]][:4] == ["Rill", "Osk", "Pell", "Quarn"]
    assert [(r[1], r[4]) for r in found["curve_table"]][:3] == [("Osk", 21), ("Osk", 42), ("Pell", 17)]
    assert [r[2] for r in found["pace_bars"]][:4] == ["Osk", "Pell", "Quarn", "Rill"]
    assert found["challenger_finals"] == [("Tarn", 0, 0, 0, "won 0 of 0")]
    assert found["series_win_pct"] == []  # no age with five matches
    assert len(found["series_cum_slam_titles"]) == 9
    assert sorted(found["line_ends_cum_slam_titles"]) == [
        ("Osk", 42, 0.0),
        ("Pell", 26, 1.0),
        ("Quarn", 36, 0.0),
        ("Rill", 22, 1.0),
        ("Stav", 21, 0.0),
        ("Tarn", 22, 0.0),
    ]


def test_there_are_23_checks():
    assert len(checks.ALL_CHECKS) == 23
    assert [c.name for c in checks.ALL_CHECKS if c.severity == "warn"] == [
        "int_player_matches.player_id.relationships"
    ]


@pytest.fixture()
def place(spark, tmp_path):
    source = feed.write_feed(tmp_path / "source")
    root = str(tmp_path / "warehouse")
    run(spark, source, root)
    return source, root


def run(spark, source, root, **options):
    return plan.full_run(spark, str(source), root, roster=roster(spark), **options)


def fact(spark, root):
    frame = Warehouse(spark, root).read(plan.FACT)
    return {r["player_match_id"]: r for r in frame.collect()}


def test_late_corrections(spark, place):
    """Inside 365 days a correction arrives, an older one waits for a full refresh; a row may
    move to another season; a vanished match stays until the full refresh."""
    source, root = place
    new = [dict(m) for m in feed.MATCHES_2019]
    new[0]["surface"] = "Clay"
    new[1]["tourney_date"] = "20181231"  # moves to another season
    feed.write_matches(source, 2019, new[:3])  # the last match vanishes
    old = [dict(m) for m in feed.MATCHES_2007]
    old[0]["surface"] = "Carpet"
    feed.write_matches(source, 2007, old)
    run(spark, source, root)
    found = fact(spark, root)
    assert len(found) == 18
    final, moved = f"2019-61-64-{feed.RILL}", f"2019-61-62-{feed.QUARN}"
    assert found[final]["surface"] == "Clay"
    assert found[moved]["tourney_date"] == D(2018, 12, 31)
    assert found[f"2007-61-64-{feed.PELL}"]["surface"] == "Grass"
    assert f"2019-90-20-{feed.STAV}" in found
    assert Warehouse(spark, root).parts(plan.FACT) == ["1998", "2007", "2018", "2019"]
    run(spark, source, root, full_refresh=True)
    found = fact(spark, root)
    assert len(found) == 16
    assert found[f"2007-61-64-{feed.PELL}"]["surface"] == "Carpet"


def contents(warehouse):
    return {n: sorted(map(repr, f.collect())) for n, f in plan.stored_marts(warehouse).items()}


def test_one_changed_file_is_built_alone(spark, place):
    """Other files' parts stay as they are; the rows are those of a rebuild."""
    source, root = place
    before = Warehouse(spark, root)
    late = [dict(m) for m in feed.MATCHES_2019]
    late[2]["minutes"], late[2]["surface"] = 99, "Carpet"
    feed.write_matches(source, 2019, late)
    run(spark, source, root)
    after = Warehouse(spark, root)

    def written(name):
        old, new = (dict(w.snapshot(plan.stored_name(name))) for w in (before, after))
        return sorted(p for p in new if old.get(p) != new[p])

    assert written("stg_matches") == written("int_player_matches") == ["atp_matches_2019.csv"]
    assert written("fct_player_matches") == ["2019"]
    assert written("stg_players") == written("stg_rankings") == written("dim_players") == written("mart_no1_weeks") == []
    assert written("mart_age_curves") == [""]
    delta = contents(after)
    assert any("Carpet" in row for row in delta["fct_player_matches"])
    plan.build(after, rebuild=True, roster=roster(spark))
    assert contents(Warehouse(spark, root)) == delta


def test_a_late_ranking_file_is_picked_again_in_its_years(spark, place):
    """A week that moves to another file and to another year: both years are picked again, others are not."""
    source, root = place
    before = dict(Warehouse(spark, root).snapshot(plan.stored_name("stg_rankings")))
    feed.write_csv(source / "atp_rankings_10s.csv", feed.RANKING_COLUMNS, [("20180101", 1, feed.RILL, 1), ("20191104", 2, feed.STAV, 9)])
    feed.write_csv(source / "atp_rankings_current.csv", feed.RANKING_COLUMNS, [("20191104", 1, feed.STAV, 9), ("20191104", 3, feed.RILL, 5)])
    run(spark, source, root)
    warehouse = Warehouse(spark, root)
    after = dict(warehouse.snapshot(plan.stored_name("stg_rankings")))
    assert sorted(p for p in after if before.get(p) != after[p]) == ["2018", "2019"]
    assert rows(warehouse, "stg_rankings", "ranking", "player_id", order=["ranking_date", "ranking", "player_id"]) == [
        (1, feed.PELL), (2, feed.OSK), (1, feed.PELL), (1, feed.RILL), (1, feed.STAV), (3, feed.RILL),
    ]
    delta = contents(warehouse)
    plan.build(warehouse, rebuild=True, roster=roster(spark))
    assert contents(Warehouse(spark, root)) == delta


def test_refresh_opens_only_the_seasons_concerned(spark, place, monkeypatch):
    source, root = place
    late = [dict(m) for m in feed.MATCHES_2019]
    late[1]["tourney_date"] = "20181231"
    feed.write_matches(source, 2019, late)
    opened = []
    usual = Warehouse.read

    def read(self, table, parts=None):
        if table == plan.FACT and parts is not None:
            opened.append(sorted(parts))
        return usual(self, table, parts)

    monkeypatch.setattr(Warehouse, "read", read)
    run(spark, source, root)
    assert ["2018", "2019"] in opened
    assert all(set(parts) <= {"2018", "2019"} for parts in opened)


def test_careers_are_continued_from_the_seasons_that_changed(spark, place):
    """Tallies of other seasons stay as they are stored; the marts over all of them are those of a rebuild."""
    source, root = place
    before = Warehouse(spark, root)
    late = [dict(m) for m in feed.MATCHES_2019]
    late[0].update(winner_id=feed.OSK, loser_id=feed.RILL)  # the slam goes to an established player
    late[1]["tourney_date"] = "20181231"  # and a match to another season
    feed.write_matches(source, 2019, late)
    run(spark, source, root)
    after = Warehouse(spark, root)
    for table in (plan.CAREERS, plan.SLAM_WINS, plan.MEETINGS):
        old, new = dict(before.snapshot(table)), dict(after.snapshot(table))
        assert sorted(p for p in new if p not in old or old[p] != new[p]) == ["2018", "2019"], table
    delta = contents(after)
    assert contents(before)["mart_age_curves"] != delta["mart_age_curves"]
    plan.build(after, rebuild=True, full_refresh=True, roster=roster(spark))
    assert contents(Warehouse(spark, root)) == delta


def test_another_roster_has_every_season_made_again(spark, place):
    _, root = place
    warehouse = Warehouse(spark, root)
    wins, careers = warehouse.snapshot(plan.SLAM_WINS), dict(warehouse.snapshot(plan.CAREERS))
    plan.build(warehouse, roster=roster(spark, [r for r in feed.ROSTER if r[1] != "Pell"]))
    after = Warehouse(spark, root)
    assert after.snapshot(plan.SLAM_WINS) == wins
    assert all(folder != careers[p] for p, folder in after.snapshot(plan.CAREERS))
    assert after.read(plan.CAREERS).where(F.col("player_id") == feed.PELL).count() == 0


def test_a_changed_file_is_checked_against_all_others(spark, place):
    """A match that a changed file shares with an untouched one, and a bad row in it, stop the run."""
    source, root = place
    before = fact(spark, root)
    again = {**feed.MATCHES_2007[0], "tourney_date": "20190702"}
    feed.write_matches(source, 2019, [*feed.MATCHES_2019, again])
    with pytest.raises(checks.DataCheckError, match="stg_matches.match_id.unique"):
        run(spark, source, root)
    bad = [dict(m) for m in feed.MATCHES_2019]
    bad[1]["surface"] = "Mud"
    feed.write_matches(source, 2019, bad)
    with pytest.raises(checks.DataCheckError, match="stg_matches.surface.accepted_values"):
        run(spark, source, root)
    assert fact(spark, root) == before


def test_checks_of_a_delta_equal_checks_of_the_whole(spark):
    """For every kind of check, over a table whose older rows are sound."""
    older = [(i, i % 5, "Clay", i % 2 == 0, f"m{i // 2}") for i in range(20)]
    came = [(3, 1, "Clay", True, "m9"), (20, None, "Mud", True, "m10"), (None, 9, None, False, "m10"), (21, 9, "Clay", True, "m11")]
    schema = "id int, parent int, surface string, flag boolean, pair string"
    whole, rows = spark.createDataFrame(older + came, schema), spark.createDataFrame(came, schema)
    tables = {"t": whole, "parents": spark.range(5).withColumnRenamed("id", "field")}
    every = [
        checks.Check("t", "unique", ("id",)),
        checks.Check("t", "not_null", ("parent",)),
        checks.Check("t", "accepted_values", ("surface",), options={"values": checks.SURFACES}),
        checks.Check("t", "unique_combination", ("id", "parent")),
        checks.Check("t", "relationships", ("parent",), options={"parent": "parents", "field": "field"}),
        checks.Check("t", "one_of_each", ("pair",), options={"flag": "flag"}),
    ]
    expected = {r["check_name"]: r["failures"] for r in checks.check_report(tables, every).collect()}
    assert sorted(expected.values()) == [1, 1, 1, 1, 1, 2]
    for at_most in (len(came), 10**9):  # broadcast or not
        found = checks.check_report(tables, every, {"t": checks.Delta(rows, at_most)}).collect()
        assert {r["check_name"]: r["failures"] for r in found} == expected


def test_failing_check_stops_the_run(spark, place):
    source, root = place
    before = fact(spark, root)
    feed.write_matches(source, 2019, [*feed.MATCHES_2019, feed.MATCHES_2019[0]])
    warehouse = Warehouse(spark, root)
    ingest(warehouse, str(source))
    with pytest.raises(checks.DataCheckError, match="stg_matches.match_id.unique"):
        plan.build(warehouse, roster=roster(spark))
    assert fact(spark, root).keys() == before.keys()
    assert warehouse.read(plan.stored_name("stg_matches")).count() == 9
    feed.write_matches(source, 2019, feed.MATCHES_2019)
    ingest(warehouse, str(source))
    plan.build(warehouse, roster=roster(spark))
    assert fact(spark, root).keys() == before.keys()


def test_unknown_player_only_warns(spark, place):
    source, root = place
    stranger = {**feed.MATCHES_2019[2], "loser_id": 1, "match_num": 19}
    feed.write_matches(source, 2019, [*feed.MATCHES_2019, stranger])
    run(spark, source, root)
    assert fact(spark, root)["2019-90-19-1"]["date_of_birth"] is None


def test_row_checks_are_counted_by_the_write(spark, tmp_path):
    """Zero settles a check; other counts, and none over an empty input, leave it to the stored rows."""
    schema = "match_id string, tourney_date date, winner_id int, loser_id int, surface string"
    rows = [(f"m{i}", D(2020, 1, 1), i, i + 1, "Clay") for i in range(50)]
    every = {c.name for c in checks.STAGING if c.table == "stg_matches" and c.row_condition is not None}
    bad = {"stg_matches.loser_id.not_null", "stg_matches.surface.accepted_values"}
    for name, given, settled in [
        ("sound", rows, every),
        ("bad", [*rows, ("m50", D(2020, 1, 1), 1, None, "Mud")], every - bad),
        ("empty", [], set()),
    ]:
        watch = checks.Watch("stg_matches")
        assert watch.settled() == set()
        frame = spark.createDataFrame(given, schema).repartition(3)
        warehouse = Warehouse(spark, str(tmp_path / name))
        warehouse.replace_parts("t/t", watch.over(frame), F.col("surface"), {r[4] for r in given}, rebalance=True)
        assert watch.settled() == settled
        tables = {"stg_matches": warehouse.read("t/t")}
        found = checks.check_report(tables, [c for c in checks.STAGING if c.name in every - settled]).collect() if every - settled else []
        assert {r["check_name"] for r in found if r["failures"]} == (bad if name == "bad" else set())


def test_a_build_scans_for_key_checks_only(spark, place, monkeypatch):
    asked = []
    usual = checks.check_report
    monkeypatch.setattr(checks, "check_report", lambda tables, due, deltas: asked.extend(due) or usual(tables, due, deltas))
    _, root = place
    plan.build(Warehouse(spark, root), rebuild=True, roster=roster(spark))
    assert {c.name for c in asked} == {c.name for c in checks.ALL_CHECKS if c.row_condition is None}
