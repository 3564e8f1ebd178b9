"""Column helpers and generic operators, against plain Python on small inputs."""

import contextlib
import datetime
import io
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from careerline import functions as fn
from careerline.operators import (
    apply_window,
    cohort_pairs,
    counts_up_to_point,
    keep_first,
    last_per_group,
    local_frame,
    ordered_list,
    quality,
    running_totals,
    small_side,
    trailing_upsert,
    two_sided,
    with_positions,
)
from careerline.operators import joins
from careerline.plans import staging
from tests import fixture_files

D = datetime.date


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_numbers_from_text_as_duckdb(spark):
    texts = ["120.0", "120.7", "120.5", "-0.5", "", " 12 ", "abc", None, "1e2", "99999999999",
             "7", "+7", "-7", "007", ".5", "5.", "e", "n/a", "12-3"]
    frame = local_frame(spark, [(t,) for t in texts], "t string")
    found = frame.select(
        "t", fn.try_number("t").alias("i"), fn.try_number("t", "bigint").alias("b")
    ).collect()
    for r in found:
        expected = duckdb.execute(
            "select try_cast($1 as integer), try_cast($1 as bigint)", [r["t"]]
        ).fetchone()
        assert (r["i"], r["b"]) == expected, r["t"]


def test_dates_from_text(spark):
    frame = local_frame(spark, [("20240229",), ("19000000",), ("1980",), ("",), (None,)], "t string")
    lenient = [r[0] for r in frame.select(fn.lenient_date("t")).collect()]
    assert lenient == [D(2024, 2, 29), None, None, None, None]
    good = local_frame(spark, [("20240229",), (None,)], "t string")
    assert [r[0] for r in good.select(fn.strict_date("t")).collect()] == [D(2024, 2, 29), None]


@pytest.mark.parametrize("text", ["20230229", "20231301", "2023-6-2", " 2003062", "2003062 ", "+2003062",
                                  "2003 123", "", "202306231", "abcdefgh"])
def test_bad_date_is_an_error(spark, text):
    frame = local_frame(spark, [(text,)], "t string")
    with pytest.raises(Exception, match="(?i)pars|invalid|malformed|cast|date"):
        frame.select(fn.strict_date("t")).collect()


def test_rounding_as_duckdb(spark):
    values = [1.005, 2.675, 0.125, 0.5, 1 / 3, 2 / 3, -1.005, 7 / 365.25] + [
        k / n for n in range(1, 60) for k in range(0, n + 1, 3)
    ]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3, 4):
        found = [r[0] for r in frame.select(fn.half_away_round("v", digits)).collect()]
        expected = [
            duckdb.execute("select round($1::double, $2)", [v, digits]).fetchone()[0] for v in values
        ]
        assert found == expected


def test_names_keys_marks(spark):
    frame = local_frame(
        spark,
        [("Ana", None, "6-3 ret"), (None, "Li", "w/o"), ("Bo", "Ek", None), ("A", "B", "6-1 6-1")],
        "a string, b string, s string",
    )
    found = frame.select(
        fn.full_name("a", "b"), fn.joined_key("a", "b"), fn.mentions_any("s", "RET", "W/O", "DEF")
    ).collect()
    assert [tuple(r) for r in found] == [
        ("Ana", None, True),
        ("Li", None, True),
        ("Bo Ek", "Bo-Ek", None),
        ("A B", "A-B", False),
    ]


def test_ages(spark):
    frame = spark.createDataFrame([(D(2000, 1, 1), D(2021, 1, 1))], "b date, d date")
    age = frame.select(fn.years_between("b", "d"), fn.age_year(fn.years_between("b", "d"))).first()
    assert age[0] == 7671 / 365.25 and age[1] == 21
    assert dict(frame.select(fn.years_between("b", "d").alias("x")).dtypes) == {"x": "double"}


def test_ratio_of_nothing_is_null(spark):
    frame = local_frame(spark, [(1, 3), (0, 0)], "a long, b long")
    assert [r[0] for r in frame.select(fn.ratio("a", "b", 4)).collect()] == [0.3333, None]


def test_keep_first_with_one_key_holding_most_rows(spark):
    random.seed(7)
    data = [(1 if random.random() < 0.6 else random.randrange(50), random.randrange(1000), i)
            for i in range(5000)]
    frame = local_frame(spark, data, "k long, v long, i long").repartition(8)
    found = keep_first(frame, ["k"], [F.asc_nulls_last("v"), F.asc_nulls_last("i")])
    best = {}
    for k, v, i in data:
        best[k] = min(best.get(k, (v, i)), (v, i))
    assert rows(found) == sorted(((k, v, i) for k, (v, i) in best.items()), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_two_sided_scans_once(spark, tmp_path):
    path = str(tmp_path / "m")
    local_frame(spark, [("m1", 1, 2)], "m string, w long, l long").write.parquet(path)
    frame = two_sided(
        spark.read.parquet(path), ["m"], {"a": "w", "b": "l"}, {"a": "l", "b": "w"}, "won"
    )
    assert rows(frame) == [("m1", 1, 2, True), ("m1", 2, 1, False)]
    assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_running_totals_and_last(spark):
    frame = local_frame(spark, [(1, 2, 5), (1, 1, 3), (2, 9, 1)], "p long, y long, n long")
    total = running_totals(frame, ["p"], [F.asc_nulls_last("y")], {"c": F.col("n")})
    assert rows(total) == [(1, 1, 3, 3), (1, 2, 5, 8), (2, 9, 1, 1)]
    assert rows(last_per_group(frame, ["p"], ["y"], ["y", "n"])) == [(1, 2, 5), (2, 9, 1)]


def test_ordered_list(spark):
    frame = local_frame(spark, [("b", 1), ("a", 2), ("c", None), (None, 0)], "t string, n long")
    assert frame.agg(ordered_list("t", "n")).first()[0] == "b, a, c"


def _pace(spark, events, pair_rows):
    members = local_frame(
        spark, [(1, "old", 50), (2, "old", 60), (3, "new", 10), (4, "new", 20), (5, "none", 1)],
        "id long, cohort string, now long",
    )
    pairs = cohort_pairs(
        members, "cohort", [("new", "old")], {"anchor": "id", "now": "now"}, {"id": "id"}
    )
    frame = local_frame(spark, events, "id long, at long, won boolean")
    return counts_up_to_point(
        pairs, pair_rows, frame, "id", "at", "now", {"n": F.lit(True), "wins": F.col("won")}
    )


def test_counts_up_to_point_both_routes(spark, monkeypatch):
    """Counts agree with brute force whether the keys are broadcast or not, one key being hot."""
    random.seed(3)
    events = [(1 if random.random() < 0.5 else random.randrange(1, 6), random.randrange(70),
               random.choice([True, False, None])) for _ in range(2000)]
    now = {3: 10, 4: 20}
    expected = sorted(
        (
            (
                anchor,
                now[anchor],
                other,
                sum(1 for e in events if e[0] == other and e[1] <= now[anchor]),
                sum(1 for e in events if e[0] == other and e[1] <= now[anchor] and e[2]),
            )
            for anchor in now
            for other in (1, 2, anchor)
        ),
        key=repr,
    )
    columns = ["anchor", "now", "id", "n", "wins"]
    assert rows(_pace(spark, events, 6).select(columns)) == expected
    large = _pace(spark, events, joins.BROADCAST_ROWS + 1)
    assert rows(large.select(columns)) == expected
    assert rows(_pace(spark, [], 6).select(columns)) == [
        (a, now[a], o, 0, 0) for a in now for o in (1, 2, a)
    ]


def test_no_cross_join_in_the_grid(spark):
    plan = _pace(spark, [(1, 1, True)], 6)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_broadcast_only_below_the_limit(spark):
    frame = local_frame(spark, [(1,)], "a long")
    assert "ResolvedHint" in small_side(frame, 10)._jdf.queryExecution().analyzed().toString()
    assert "Hint" not in small_side(frame, 10**6)._jdf.queryExecution().analyzed().toString()


def _dated(spark, data):
    return spark.createDataFrame(
        [(k, D.fromisoformat(d) if d else None, v) for k, d, v in data],
        "k string, d date, v string",
    )


def test_trailing_upsert(spark):
    target = _dated(
        spark,
        [("old", "2020-01-01", "a"), ("edge", "2022-06-01", "a"), ("gone", "2023-05-01", "a"),
         ("new", "2023-06-01", "a"), (None, None, "a")],
    )
    source = _dated(
        spark,
        [("old", "2020-01-01", "b"), ("edge", "2022-06-01", "b"), ("new", "2023-06-01", "b"),
         ("more", "2023-07-01", "b"), ("undated", None, "b")],
    )
    found = trailing_upsert(target, source, "k", "d")
    values = {r["k"]: r["v"] for r in found.collect()}
    assert values == {"old": "a", "edge": "b", "gone": "a", "new": "b", "more": "b", None: "a"}
    assert trailing_upsert(target, source, "k", "d", full_refresh=True) is source
    assert trailing_upsert(None, source, "k", "d") is source


def test_doubles_inside_the_window_stay_for_the_check(spark):
    window = _dated(spark, [("x", "2023-01-01", "1"), ("x", "2023-01-01", "2")])
    target = _dated(spark, [("x", "2023-01-01", "0"), ("y", "2023-01-01", "0")])
    refreshed = apply_window(target, window, "k")
    assert refreshed.count() == 3
    assert rows(quality.unique(refreshed, "k")) == [("x", 2)]


def test_checks_treat_null_as_stated(spark):
    frame = local_frame(
        spark, [("a", 1), ("a", 1), (None, 1), (None, 2), ("b", None)], "t string, n long"
    )
    assert rows(quality.unique(frame, "t")) == [("a", 2)]
    assert rows(quality.unique_combination(frame, ["t", "n"])) == [("a-1", 2), (None, 3)]
    assert quality.not_null(frame, "t").count() == 2
    assert rows(quality.accepted_values(frame, "t", ["a"])) == [("b", 1)]
    parent = local_frame(spark, [("a",)], "p string")
    assert rows(quality.relationships(frame, "t", parent, "p")) == [("b", 1)]


def test_one_of_each(spark):
    data = [("ok", True), ("ok", False), ("two", True), ("two", True), ("single", False)]
    frame = local_frame(spark, data, "k string, w boolean")
    assert rows(quality.one_of_each(frame, "k", "w")) == [("single", 1, 0), ("two", 2, 2)]


def generated_method_sizes(frame):
    """Bytes of the largest method in each compiled stage of the plan."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        frame.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]


def test_typing_is_compiled(spark):
    """The JVM leaves methods of 8,000 bytes and more to the interpreter."""
    texts = lambda names: spark.range(9).select(*[F.col("id").cast("string").alias(c) for c in names])
    columns = [*fixture_files.MATCH_COLUMNS, "_source_file"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans that adapt show no code before they run
    for typed in (
        staging.stg_matches(texts(columns)),
        staging.stg_players(texts(fixture_files.PLAYER_COLUMNS)),
        staging.stg_rankings(texts(fixture_files.RANKING_COLUMNS)),
    ):
        sizes = generated_method_sizes(typed)
        assert sizes and max(sizes) < 8000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_days_match_the_pattern_parser(spark):
    days = spark.range(0, 800_000, 13).select(F.date_add(F.to_date(F.lit("0001-01-01")), F.col("id").cast("int")).alias("day"))
    texts = days.select("day", F.date_format("day", "yyyyMMdd").alias("text"))
    for typed in (fn.strict_date, fn.lenient_date):
        assert texts.where(~F.col("day").eqNullSafe(typed("text"))).count() == 0
    bad = ["", "1999", "19990229", "20000230", "19991301", "19990100", "00000101", "1999-1-1", "19990101 ", "19990101\n", "١٩٩٩٠١٠١"]
    frame = spark.createDataFrame([(x,) for x in [*bad, None]], "text string")
    assert frame.where(fn.lenient_date("text").isNotNull()).count() == 0
    assert frame.where("text IS NULL").select(fn.strict_date("text").alias("d")).first()["d"] is None
    for text in bad:
        with pytest.raises(Exception, match="not a yyyyMMdd date"):
            frame.where(F.col("text") == text).select(fn.strict_date("text")).collect()


def test_positions_are_those_of_one_sort(spark, tmp_path):
    """One key holds most rows; ties go by the next column; NULLs come where the order puts them."""
    dice = random.Random(9)
    data = [(dice.choice([7] * 8 + [None, 1, 2]), k, dice.choice(["a", None])) for k in range(5000)]
    frame = local_frame(spark, data, "k long, n long, t string")

    def store(dealt):
        path = str(tmp_path / "dealt")
        dealt.write.parquet(path)
        return spark.read.parquet(path)

    placed = with_positions(frame, [F.desc_nulls_last("k"), F.asc_nulls_last("t"), F.asc("n")], store).collect()
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[2] is None, r[2] or "", r[1]))
    assert [tuple(r)[:3] for r in sorted(placed, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in placed) == list(range(1, 5001))
