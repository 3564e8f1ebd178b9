"""Quoted CSV in splits: the same rows as a read of whole files."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from careerline.sources import ingest as load
from careerline.sources.records import STRAY_QUOTE, has_stray_quote, read_quoted_csv, split_states
from careerline.sources.warehouse import Warehouse
from registry.compare import difference
from tests import fixture_files as feed


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(dice, must_quote):
    parts = ["word", " ", ",", "\n", "\r\n", '""', "é", "日本", "\n\n", "\t"] if must_quote else ["word", " ", "é", "7", ""]
    text = "".join(dice.choices(parts, k=dice.randrange(12)))
    return f'"{text}"' if must_quote else text


def write(path, dice, rows, end="\n", last=True):
    lines = [",".join(["key", "text", "more"])]
    for k in range(rows):
        cells = [str(k), *(field(dice, dice.random() < 0.5) for _ in range(2))]
        lines.append(",".join(cells))
        if dice.random() < 0.05:
            lines.append("")  # blank lines are skipped
    path.write_bytes((end.join(lines) + (end if last else "")).encode())
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_are_those_of_the_whole_files(spark, tmp_path, small_splits, end):
    dice = random.Random(end)
    paths = [write(tmp_path / f"{k}.csv", dice, rows, end, k % 2 == 0) for k, rows in enumerate([0, 1, 400, 900])]
    states, unfit = split_states(spark, paths)
    assert not unfit and len(states) > 20 and any(r["inside"] for r in states)
    names = ["key", "text", "more"]
    found = read_quoted_csv(spark, paths, names, "file")
    whole = load.read_text_csv(spark, paths, names).select("*", F.col("_metadata.file_name").alias("file"))
    rows = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    assert rows(found) == rows(whole)
    assert found.count() == 1301


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    path = write(tmp_path / "x.csv", random.Random(1), 900)
    split = read_quoted_csv(spark, [path], ["key", "text", "more"], "file")
    assert len({r[0] for r in split.select(F.spark_partition_id()).collect()}) > 10
    assert len({r[0] for r in load.read_text_csv(spark, [path], ["key", "text", "more"]).select(F.spark_partition_id()).collect()}) == 1


def test_what_cannot_be_split_is_told(spark, tmp_path, small_splits):
    sound = tmp_path / "sound.csv"
    sound.write_text('a,b\n1,"x\ny"\n')
    odd = tmp_path / "odd.csv"
    odd.write_text('a,b\n1,"x\ny"\n2,5" wide\n')
    long = tmp_path / "long.csv"
    long.write_text('a,b\n1,"' + "line\n" * 3000 + '"\n')
    states, unfit = split_states(spark, [str(p) for p in (sound, odd, long)])
    assert {p.rsplit("/", 1)[-1] for p in unfit} == {"odd.csv", "long.csv"}


def test_stray_quotes(spark):
    cases = {
        "a,b": False, '"a,b",c': False, 'a,"b""c"': False, 'a,"b\nc",""': False, '"a","b","c"': False,
        'a"b,c"d': True, '"a"b,c': True, 'a, "b"': True, '"a" ,b': True, '5",6"': True,
    }
    frame = spark.createDataFrame([(x,) for x in cases], "r string")
    assert {r["r"]: r["s"] for r in frame.select("r", has_stray_quote(F.col("r")).alias("s")).collect()} == cases
    long = spark.createDataFrame([('"' + '""x' * 200_000 + '",b',)], "r string")
    assert long.select(has_stray_quote(F.col("r"))).first()[0] is False


def test_stray_quotes_are_an_error_in_splits_and_loaded_whole(spark, tmp_path):
    source = feed.write_feed(tmp_path / "source")
    path = source / "atp_rankings_00s.csv"
    path.write_text('ranking_date,rank,player,points\n20070709,1,12" wide,5\n20070709,2,13" wide,6\n20070716,3,"a\nb",7\n')
    with pytest.raises(Exception, match=STRAY_QUOTE):
        read_quoted_csv(spark, [str(path)], feed.RANKING_COLUMNS, "file").collect()
    warehouse = Warehouse(spark, str(tmp_path / "warehouse"))
    assert load.ingest(warehouse, str(source))["loaded"] == 7
    players = [r["player"] for r in warehouse.read(load.raw_table("rankings")).where("_source_file LIKE '%00s%'").orderBy("rank").collect()]
    assert players == ['12" wide', '13" wide', "a\nb"]


def test_broken_rows_in_splits(spark, tmp_path, small_splits):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"x\ny"\n2\n3,"p\nq",r\n4,z\n')
    kept = read_quoted_csv(spark, [str(path)], ["a", "b"], "file", broken="bad").collect()
    assert sorted((r["a"], r["b"]) for r in kept if r["bad"] is None) == [("1", "x\ny"), ("4", "z")]
    assert len([r for r in kept if r["bad"] is not None]) == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        read_quoted_csv(spark, [str(path)], ["a", "b"], "file").collect()


ODD_TEXTS = [
    None, "", " ", "  a ", '"', '""', '"whole"', 'end"', "a,b", "a\nb", "\n", "\r", "a\r\nb\r\n", "\\", "\\N", '\\"', "null",
    "\x00", 'a\x00"b', '\x00,"', "#c", "\ufeffx", "日本\U0001f600", "\t",
]


def test_csv_round_trip_gives_back_every_text(spark, tmp_path):
    pick = lambda k, some: some[k % len(some)]
    rows = [(k, pick(k, [None, "", "en", " "]), pick(k, ["", "web", None]), text) for k, text in enumerate(ODD_TEXTS)]
    rows += [(None, None, None, None), (None, "", "", ""), *rows[:3]]
    documents = pd.DataFrame(rows, columns=["doc_id", "lang", "source", "text"]).astype({"doc_id": "Int64"})
    documents.to_parquet(tmp_path / "documents.parquet")
    query, statement = contract.queries()["csv_round_trip"], contract.oracle_sql()["csv_round_trip"]
    found = query(spark, str(tmp_path))
    digest = lambda text: None if text is None else hashlib.md5(text.encode()).hexdigest()
    whole = [(*row, None if row[3] is None else len(row[3]), digest(row[3])) for row in rows]
    columns = ["doc_id", "lang", "source", "text", "n_chars", "text_md5"]
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=repr) == sorted(whole, key=repr)
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert difference(spark, connection, str(tmp_path), query, statement) is None


def test_the_load_takes_empty_texts_for_null(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,""\n2,\n"",x\n')
    rows = lambda **how: sorted((tuple(r) for r in load.read_text_csv(spark, [str(path)], ["a", "b"], **how).collect()), key=repr)
    assert rows() == rows(whole=False) == [("1", None), ("2", None), (None, "x")]
    assert rows(exact=True) == rows(whole=False, exact=True) == [("", "x"), ("1", ""), ("2", None)]
