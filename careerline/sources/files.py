"""Finding source files and fingerprinting their content."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from careerline.operators import keep_first, local_frame

# The file name of each entity. The first group of a match file is its season.
ENTITY_PATTERNS = {
    "matches": r"^atp_matches_(\d{4})\.csv$",
    "players": r"^atp_players\.csv$",
    "rankings": r"^atp_rankings_(\d{2}s|current)\.csv$",
}

FILE_SCHEMA = "path string, length long, modified long, source_file string, entity string"

# Stands before every hash in the manifest, so that another way of hashing reloads the files.
ALGORITHM = "lines-1"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classify(name: Column) -> Column:
    """The entity a file name stands for; NULL for other files."""
    entity = F.lit(None).cast("string")
    for candidate, pattern in ENTITY_PATTERNS.items():
        entity = F.when(name.rlike(pattern), F.lit(candidate)).otherwise(entity)
    return entity


def season_of(name: Column) -> Column:
    """The season in the name of a match file; NULL for other files."""
    return F.nullif(
        F.regexp_extract(name, ENTITY_PATTERNS["matches"], 1), F.lit("")
    ).try_cast("int")


def recognised(files: DataFrame, min_year: int) -> DataFrame:
    """Files of a known entity; match files of earlier seasons are left out."""
    season = season_of(F.col("source_file"))
    return files.withColumn("entity", classify(F.col("source_file"))).where(
        F.col("entity").isNotNull() & (season.isNull() | (season >= min_year))
    )


def discover(
    spark: SparkSession, source_dir: str, min_year: int, name: Callable[[Column], Column] = base_name
) -> DataFrame:
    """(path, length, modified, source_file, entity) of the recognised files below ``source_dir``.

    A base name is one partition: of two files with the same name the later path wins. Content
    is not read here; ``modified`` is in microseconds. ``name`` tells a file's name from its path.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(source_dir)
        .select("path", "length", F.unix_micros("modificationTime").alias("modified"), name(F.col("path")).alias("source_file"))
    )
    return keep_first(recognised(listed, min_year), ["source_file"], [F.desc("path")])


def _slices(line: Column) -> list[Column]:
    """Two 60-bit numbers of the SHA-256 of the bytes of a line."""
    digest = F.sha2(line.cast("binary"), 256)
    return [
        F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(19,0)") for start in (1, 16)
    ]


def file_prints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_hash, header, quoted_newline) of every file that is not empty.

    The hash is one for all sizes. It covers the file's length and, for the lines between line
    feeds, the sum of their hashes and the sum of the hashes times the line numbers. So it depends
    on every byte and its place, and still adds up: each split of a file is summed on its own,
    and one row per split says how many lines lie before it. An odd number of quotes on a
    line tells that a quoted field runs over the line end.
    """
    # With a given separator the reader leaves carriage returns where they are.
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
    )
    h, g = _slices(F.col("value"))
    numbered = lines.withColumn("h", h).withColumn("g", g)
    place = F.col("place").cast("decimal(11,0)")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = numbered.groupBy("path", "start").agg(
        F.max("size").alias("size"),
        F.count("*").alias("n"),
        F.min("place").alias("first"),
        F.sum("h").alias("h"),
        F.sum("g").alias("g"),
        F.sum(F.col("h") * place).alias("hp"),
        F.sum(F.col("g") * place).alias("gp"),
        F.min_by("value", "place").alias("header"),
        F.max(quotes % 2).alias("odd"),
    )
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    placed = splits.withColumn("shift", shift.cast("decimal(11,0)"))
    sums = [
        F.max("size"),
        F.sum("n"),
        F.sum("h"),
        F.sum("g"),
        F.sum(F.col("hp") + F.col("shift") * F.col("h")),
        F.sum(F.col("gp") + F.col("shift") * F.col("g")),
    ]
    return placed.groupBy("path").agg(
        _named_hash(sums).alias("file_hash"),
        F.min_by("header", "start").alias("header"),
        (F.max("odd") == 1).alias("quoted_newline"),
    )


def _named_hash(sums: Sequence[Column]) -> Column:
    """The sums of a file as the hash that the manifest keeps."""
    text = F.concat_ws("-", *[x.cast("string") for x in sums])
    return F.concat(F.lit(f"{ALGORITHM}:"), F.sha2(text, 256))


def fingerprint(spark: SparkSession, files: list[Row]) -> DataFrame:
    """``files`` (rows of ``discover``) with file_hash, header and quoted_newline.

    The list holds one entry per file, as Spark's own file index does.
    """
    prints = file_prints(spark, [f["path"] for f in files])
    content = prints.withColumn("source_file", base_name(F.col("path"))).drop("path")
    known = local_frame(spark, files, FILE_SCHEMA)
    empty = _named_hash([F.lit(0)] * 6)
    return known.join(content, "source_file", "left").select(
        *known.columns,
        F.coalesce("file_hash", empty).alias("file_hash"),
        F.regexp_replace(F.coalesce("header", F.lit("")), "^\ufeff|\r$", "").alias("header"),
        F.coalesce("quoted_newline", F.lit(False)).alias("quoted_newline"),
    )
