"""The load: idempotent, one replaceable part per file."""

import os

import pytest
from pyspark.sql import functions as F

from careerline.sources import ingest as load
from careerline.sources.files import classify, discover, file_prints, season_of
from careerline.sources.warehouse import Warehouse
from tests import fixture_files as feed

ENTITIES = ("matches", "players", "rankings")


@pytest.fixture()
def place(tmp_path):
    return feed.write_feed(tmp_path / "source"), str(tmp_path / "warehouse")


def counts(warehouse):
    return [warehouse.read(load.raw_table(e)).count() for e in ENTITIES]


def matches(warehouse):
    return warehouse.read(load.raw_table("matches"))


def test_second_load_changes_nothing(spark, place):
    source, root = place
    first = load.ingest(Warehouse(spark, root), str(source))
    assert first == {"skipped": 0, "loaded": 7, "reloaded": 0}
    warehouse = Warehouse(spark, root)
    assert counts(warehouse) == [9, 7, 6]
    assert load.ingest(warehouse, str(source)) == {"skipped": 7, "loaded": 0, "reloaded": 0}
    assert counts(warehouse) == [9, 7, 6]


def test_everything_is_text_with_lineage(spark, place):
    source, root = place
    warehouse = Warehouse(spark, root)
    load.ingest(warehouse, str(source))
    types = dict(matches(warehouse).dtypes)
    assert len(types) == len(feed.MATCH_COLUMNS) + 3
    assert {types[c] for c in feed.MATCH_COLUMNS} == {"string"}
    row = matches(warehouse).where("match_num = '30'").first()
    assert row["_source_file"] == "atp_matches_1998.csv"
    assert row["winner_seed"] is None
    manifest = {r["source_file"]: r for r in load.read_manifest(warehouse).collect()}
    assert manifest["atp_matches_1998.csv"]["file_hash"] == row["_file_hash"]
    assert manifest["atp_rankings_00s.csv"]["row_count"] == 3


def print_by_hand(data: bytes) -> str:
    import hashlib

    lines = data.split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    hashes = [hashlib.sha256(line).hexdigest() for line in lines]
    h, g = ([int(x[a : a + 15], 16) for x in hashes] for a in (0, 15))
    weighed = [sum(k * v for k, v in enumerate(x)) for x in (h, g)]
    text = "-".join(map(str, [len(data), len(lines), sum(h), sum(g), *weighed]))
    return "lines-1:" + hashlib.sha256(text.encode()).hexdigest()


def test_file_hash_is_that_of_the_bytes(spark, place):
    source, root = place
    warehouse = Warehouse(spark, root)
    load.ingest(warehouse, str(source))
    for row in load.read_manifest(warehouse).collect():
        assert row["file_hash"] == print_by_hand((source / row["source_file"]).read_bytes())


def test_hash_does_not_depend_on_splits_but_on_every_byte(spark, tmp_path):
    lines = [f"{k},{k * k},text {k % 7}".encode() for k in range(3000)]
    data = b"\n".join(lines) + b"\n"
    variants = {
        "plain": data,
        "swapped": data.replace(b"10,100,", b"x").replace(b"11,121,", b"10,100,").replace(b"x", b"11,121,"),
        "carriage": data.replace(b"\n", b"\r\n"),
        "open": data[:-1],
        "blank": data + b"\n",
        "reversed": b"\n".join(reversed(lines)) + b"\n",
        "invalid": data.replace(b"text 3", b"text \xff"),
    }
    for name, content in variants.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    paths = [str(tmp_path / f"{name}.csv") for name in variants]
    whole = {r["path"].split("/")[-1][:-4]: r["file_hash"] for r in file_prints(spark, paths).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = file_prints(spark, paths)
        assert spark.read.text(paths).rdd.getNumPartitions() > len(paths)
        split = {r["path"].split("/")[-1][:-4]: r["file_hash"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == split == {name: print_by_hand(content) for name, content in variants.items()}
    assert len(set(whole.values())) == len(variants)


def test_only_modified_files_are_read_again(spark, place, monkeypatch):
    """A touched file is compared by content; ``rehash`` compares all of them."""
    source, root = place
    load.ingest(Warehouse(spark, root), str(source))
    read = []
    usual = load.fingerprint
    monkeypatch.setattr(load, "fingerprint", lambda spark, files: read.append(sorted(f["source_file"] for f in files)) or usual(spark, files))
    assert load.ingest(Warehouse(spark, root), str(source)) == {"skipped": 7, "loaded": 0, "reloaded": 0}
    path = source / "atp_players.csv"
    os.utime(path, (path.stat().st_atime + 60, path.stat().st_mtime + 60))
    assert load.ingest(Warehouse(spark, root), str(source)) == {"skipped": 7, "loaded": 0, "reloaded": 0}
    later = path.stat()
    path.write_text(path.read_text().replace("NOR", "FRO"))
    assert load.ingest(Warehouse(spark, root), str(source)) == {"skipped": 6, "loaded": 0, "reloaded": 1}
    # The same length and time of modification hide a change from all but a comparison by content.
    known = path.stat()
    path.write_text(path.read_text().replace("FRO", "NOR"))
    os.utime(path, ns=(known.st_atime_ns, known.st_mtime_ns))
    assert later.st_size == known.st_size
    assert load.ingest(Warehouse(spark, root), str(source))["skipped"] == 7
    assert load.ingest(Warehouse(spark, root), str(source), rehash=True)["reloaded"] == 1
    assert [len(names) for names in read] == [1, 1, 7]


def test_rewritten_order_is_a_change(spark, place):
    source, root = place
    load.ingest(Warehouse(spark, root), str(source))
    path = source / "atp_rankings_10s.csv"
    head, *rows = path.read_text().splitlines()
    path.write_text("\n".join([head, *reversed(rows)]) + "\n")
    assert load.ingest(Warehouse(spark, root), str(source))["reloaded"] == 1


def test_changed_file_replaces_its_part(spark, place):
    source, root = place
    load.ingest(Warehouse(spark, root), str(source))
    path = source / "atp_matches_2019.csv"
    path.write_text(path.read_text().replace("6-7 6-4 6-2", "6-7(5) 6-4 6-2"))
    warehouse = Warehouse(spark, root)
    assert load.ingest(warehouse, str(source)) == {"skipped": 6, "loaded": 0, "reloaded": 1}
    assert counts(warehouse) == [9, 7, 6]
    assert matches(warehouse).where("score = '6-7(5) 6-4 6-2'").count() == 1


def test_line_end_inside_quotes(spark, place):
    source, root = place
    rows = [{**feed.MATCHES_1998[0], "score": 'one\n"two", three'}]
    feed.write_matches(source, 1998, rows)
    warehouse = Warehouse(spark, root)
    load.ingest(warehouse, str(source))
    assert matches(warehouse).where("match_num = '30'").where(
        F.col("score") == 'one\n"two", three'
    ).count() == 1


def test_columns_are_matched_by_name(spark, place):
    source, root = place
    reordered = [c for c in reversed(feed.MATCH_COLUMNS) if c != "minutes"]
    feed.write_matches(source, 2019, feed.MATCHES_2019, reordered)
    warehouse = Warehouse(spark, root)
    load.ingest(warehouse, str(source))
    row = matches(warehouse).where("match_num = '21'").first()
    assert (row["winner_id"], row["surface"], row["minutes"]) == (str(feed.STAV), "Hard", None)


def test_extra_column_is_an_error_and_loads_nothing_of_the_entity(spark, place):
    source, root = place
    load.ingest(Warehouse(spark, root), str(source))
    feed.write_matches(source, 2019, feed.MATCHES_2019, [*feed.MATCH_COLUMNS, "weather"])
    warehouse = Warehouse(spark, root)
    with pytest.raises(ValueError, match="weather"):
        load.ingest(warehouse, str(source))
    assert counts(Warehouse(spark, root)) == [9, 7, 6]


def test_a_broken_file_does_not_hold_up_the_others(spark, place):
    source, root = place
    path = source / "atp_rankings_current.csv"
    sound = path.read_text()
    path.write_text(sound + "20191111,1\n")
    feed.write_matches(source, 2019, feed.MATCHES_2019, [*feed.MATCH_COLUMNS, "weather"])
    with pytest.raises(load.LoadError, match="(?i)malformed") as error:
        load.ingest(Warehouse(spark, root), str(source))
    assert sorted(error.value.failed) == ["atp_matches_2019.csv", "atp_rankings_current.csv"]
    assert error.value.outcomes == {"skipped": 0, "loaded": 5, "reloaded": 0}
    assert counts(Warehouse(spark, root)) == [5, 7, 5]
    path.write_text(sound)
    feed.write_matches(source, 2019, feed.MATCHES_2019)
    assert load.ingest(Warehouse(spark, root), str(source)) == {"skipped": 5, "loaded": 2, "reloaded": 0}
    assert counts(Warehouse(spark, root)) == [9, 7, 6]


def test_file_reduced_to_its_header_loses_its_rows(spark, place):
    source, root = place
    load.ingest(Warehouse(spark, root), str(source))
    feed.write_matches(source, 2007, [])
    warehouse = Warehouse(spark, root)
    assert load.ingest(warehouse, str(source))["reloaded"] == 1
    assert counts(warehouse) == [6, 7, 6]
    manifest = load.read_manifest(warehouse).where("source_file = 'atp_matches_2007.csv'").first()
    assert manifest["row_count"] == 0
    assert load.ingest(warehouse, str(source))["skipped"] == 7


def test_vanished_file_and_raised_min_year_keep_their_rows(spark, place):
    source, root = place
    load.ingest(Warehouse(spark, root), str(source))
    (source / "atp_matches_2019.csv").rename(source / "other.csv")
    warehouse = Warehouse(spark, root)
    assert load.ingest(warehouse, str(source), min_year=2005)["skipped"] == 5
    assert counts(warehouse) == [9, 7, 6]


def test_crash_between_data_and_manifest_loads_again(spark, place, monkeypatch):
    source, root = place
    monkeypatch.setattr(load, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        load.ingest(Warehouse(spark, root), str(source))
    monkeypatch.undo()
    warehouse = Warehouse(spark, root)
    assert load.ingest(warehouse, str(source))["loaded"] == 7
    assert counts(warehouse) == [9, 7, 6]


def test_same_name_in_two_folders_is_one_part(spark, place):
    source, root = place
    later = source / "later"
    later.mkdir()
    feed.write_csv(later / "atp_players.csv", feed.PLAYER_COLUMNS, feed.PLAYERS[:2])
    warehouse = Warehouse(spark, root)
    load.ingest(warehouse, str(source))
    assert warehouse.read(load.raw_table("players")).count() == 2


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "notes.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="no source files"):
        load.ingest(Warehouse(spark, str(tmp_path / "w")), str(tmp_path))


def test_file_names(spark, place):
    source, _ = place
    names = {
        "atp_matches_2003.csv": ("matches", 2003),
        "atp_matches_doubles_2003.csv": (None, None),
        "atp_players.csv": ("players", None),
        "atp_rankings_current.csv": ("rankings", None),
        "atp_rankings_1990.csv": (None, None),
    }
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    rows = frame.select("n", classify(F.col("n")).alias("e"), season_of(F.col("n")).alias("s"))
    assert {r["n"]: (r["e"], r["s"]) for r in rows.collect()} == names
    found = discover(spark, str(source), 2005).select("source_file").collect()
    assert "atp_matches_1998.csv" not in [r["source_file"] for r in found]


def test_an_old_handle_cannot_touch_what_was_published_since(spark, tmp_path):
    root = str(tmp_path / "w")
    old = Warehouse(spark, root)
    new = Warehouse(spark, root)
    new.replace("raw/t", spark.range(5).toDF("x"))
    new.publish()
    old.replace("raw/t", spark.range(2).toDF("x"))
    assert Warehouse(spark, root).read("raw/t").count() == 5
    with pytest.raises(RuntimeError, match="raw/t"):
        old.publish()
    assert Warehouse(spark, root).read("raw/t").count() == 5


def test_a_lost_pointer_write_leaves_the_last_one(spark, tmp_path):
    """Pointers are written in two folders in turn; whatever happens to the newer one, the older one is whole."""
    root = tmp_path / "w"
    for rows in (5, 2, 9):
        warehouse = Warehouse(spark, str(root))
        warehouse.replace("raw/t", spark.range(rows).toDF("x"))
        warehouse.publish()
        assert Warehouse(spark, str(root)).read("raw/t").count() == rows
    assert sorted(p.name for p in root.iterdir() if p.name.startswith("pointer")) == ["pointer-0", "pointer-1"]
    for path in (root / "pointer-1").glob("*.parquet"):  # the third publish, as if it had died while writing
        path.unlink()
    assert Warehouse(spark, str(root)).read("raw/t").count() == 2


def test_a_table_is_written_once_per_publish(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    warehouse.replace("raw/t", spark.range(5).toDF("x"))
    with pytest.raises(ValueError, match="publish"):
        warehouse.replace("raw/t", spark.range(2).toDF("x"))
    warehouse.publish()
    with pytest.raises(RuntimeError, match="lost"), warehouse.publishing():
        warehouse.replace("raw/t", spark.range(2).toDF("x"))
        raise RuntimeError("lost")
    assert warehouse.read("raw/t").count() == 5
