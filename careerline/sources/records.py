"""CSV files whose quoted fields run over line ends, read in splits.

Whether a line starts inside a quoted field depends on all quotes before it. One scan counts per split how often that
changes, a running sum over one row per split tells the state at its start, and then every split puts its own
records together. Only the two halves of a record that lies across a border are joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from careerline.operators.local import local_frame

#: Splits of one read. Their states, under 100 bytes each, are broadcast; at 128 MB a split this is over 100 TB.
MAX_SPLITS = 1_000_000
STRAY_QUOTE = "a quote inside an unquoted field"
_STATES = "path string, start long, number long, inside boolean, carriage boolean"
_FOUND = "file_name string, path string, number long, kind string, record binary, carriage boolean"
# A field in quotes, with the separator before it; what is in doubt for a regular expression that may run back is possessive.
_QUOTED_FIELD = r'(?s)(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|\z)'


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines between line feeds, in the order of each split; ``turns`` tells an odd number of quotes."""
    text = spark.read.option("lineSep", "\n").text(list(paths))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        (quotes % 2 == 1).alias("turns"),
    )


def split_states(spark: SparkSession, paths: Sequence[str]) -> tuple[list[Row], set[str]]:
    """Per split whether it starts inside quotes, and the paths that cannot be read in splits.

    Those are files with an odd number of quotes, and files with a record that covers a whole split.
    """
    lines = _lines(spark, paths).withColumn("place", F.monotonically_increasing_id())
    counted = lines.groupBy("path", "start").agg(
        F.count_if("turns").alias("turns"), F.min_by(F.col("value").endswith("\r"), "place").alias("carriage")
    )
    of_file = Window.partitionBy("path").orderBy("start")
    before = F.coalesce(F.sum("turns").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy("path")
    states = counted.select(
        "path",
        "start",
        F.row_number().over(of_file).cast("long").alias("number"),
        (before % 2 == 1).alias("inside"),
        F.first("carriage").over(of_file).alias("carriage"),
        "turns",
        F.sum("turns").over(everything).alias("all_turns"),
    )
    rows = states.limit(MAX_SPLITS + 1).collect()  # one small row per split, as in Spark's own list of them
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits in one read; raise spark.sql.files.maxPartitionBytes")
    unfit = {r["path"] for r in rows if r["all_turns"] % 2 or (r["inside"] and not r["turns"])}
    return rows, unfit


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each split: ``whole`` ones, the ``head`` that ends a record of the split before, and the ``tail``
    that the next one ends. The first whole record of a file is its ``header``."""
    split, inside, held, seen = None, False, [], False

    def rows(found: list[tuple[str, bytes]], of: tuple) -> pd.DataFrame:
        name, path, _, number, _, carriage = of
        table = pd.DataFrame(found, columns=["kind", "record"])
        return table.assign(file_name=name, path=path, number=number, carriage=carriage)[[c.split()[0] for c in _FOUND.split(", ")]]

    for batch in batches:
        place = (batch["path"] != batch["path"].shift()) | (batch["start"] != batch["start"].shift())
        for _, part in batch.groupby(place.cumsum(), sort=False):
            first = part.iloc[0]
            here = (first["file_name"], first["path"], first["start"], first["number"], bool(first["inside"]), bool(first["carriage"]))
            if split is None or here[1:3] != split[1:3]:
                if held:
                    yield rows([("tail", b"\n".join(held))], split)
                split, inside, held, seen = here, here[4], [], here[2] > 0
                starts_inside = inside
            values = part["value"].tolist()
            after = (int(inside) + np.cumsum(part["turns"].to_numpy(dtype=np.int64))) % 2
            before = np.append(int(inside), after[:-1])
            found: list[tuple[str, bytes]] = []
            # Lines that are records of their own are taken in runs, the others one by one.
            single = (before == 0) & (after == 0)
            borders = np.flatnonzero(np.diff(single.astype(np.int8))) + 1
            for run in np.split(np.arange(len(values)), borders):
                if single[run[0]]:
                    found.extend(("whole", values[k]) for k in run)
                    continue
                for k in run:
                    held.append(values[k])
                    if after[k] == 0:
                        found.append(("head" if starts_inside else "whole", b"\n".join(held)))
                        held, starts_inside = [], False
            if not seen and found:
                found[0], seen = ("header", found[0][1]), True
            inside = bool(after[-1])
            if found:
                yield rows(found, split)
    if held:
        yield rows([("tail", b"\n".join(held))], split)


def _records(spark: SparkSession, paths: Sequence[str], states: Sequence[Row]) -> DataFrame:
    """``file_name`` and ``record`` (text) of every record but the headers."""
    known = local_frame(spark, [tuple(r)[:5] for r in states], _STATES)
    placed = _lines(spark, paths).join(F.broadcast(known), ["path", "start"])  # at most MAX_SPLITS rows
    columns = ["file_name", "path", "start", "number", "inside", "carriage", "turns"]
    found = placed.select(*columns, F.col("value").cast("binary").alias("value")).mapInPandas(_assemble, _FOUND)
    across = found.where("kind IN ('tail', 'head')").withColumn("number", F.col("number") - F.when(F.col("kind") == "head", 1).otherwise(0))
    halves = across.groupBy("path", "number", "file_name", "carriage").agg(
        F.max(F.when(F.col("kind") == "tail", F.col("record"))).alias("tail"), F.max(F.when(F.col("kind") == "head", F.col("record"))).alias("head")
    )
    joined = halves.select("file_name", F.concat("tail", F.lit(b"\n"), "head").alias("record"), "carriage")
    every = found.where("kind = 'whole'").select("file_name", "record", "carriage").unionByName(joined)
    text = F.col("record").cast("string")
    # Where lines end with a carriage return, the parser of whole files reads line ends as line feeds inside quotes as well.
    plain = F.when(F.col("carriage"), F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\r\\z", "")).otherwise(text)
    return every.select("file_name", plain.alias("record")).where("record <> ''")


def has_stray_quote(record: Column) -> Column:
    """Whether a quote stands where no quoted field starts or ends, so that counting quotes can mislead."""
    return record.contains('"') & F.regexp_replace(record, _QUOTED_FIELD, "$1").contains('"')


def read_quoted_csv(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str], file_name: str, broken: str | None = None, states: Sequence[Row] | None = None
) -> DataFrame:
    """Every column as text, and ``file_name``; the rows that a read of whole files gives.

    All ``paths`` have the same header and can be read in splits (see :func:`split_states`). Broken rows and rows with a
    stray quote are an error, or kept in the column ``broken``.
    """
    states = split_states(spark, paths)[0] if states is None else states
    names = [*columns, broken] if broken else columns
    options = {"mode": "PERMISSIVE" if broken else "FAILFAST", "escape": '"', "multiLine": "true"}
    if broken:
        options["columnNameOfCorruptRecord"] = broken
    record = F.col("record")
    sound = record if broken else F.when(has_stray_quote(record), F.raise_error(F.concat(F.lit(f"{STRAY_QUOTE}: "), record))).otherwise(record)
    parsed = _records(spark, paths, states).select("file_name", record, F.from_csv(sound, _ddl(names), options).alias("row"))
    fields = [F.col("row").getField(c).alias(c) for c in columns]
    if broken:
        fields.append(F.when(has_stray_quote(record), record).otherwise(F.col("row").getField(broken)).alias(broken))
    return parsed.select(*fields, F.col("file_name").alias(file_name))


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
