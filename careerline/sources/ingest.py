"""Idempotent text load: one replaceable part per source file, tracked in a manifest.

Unchanged files are skipped, changed ones replace their part. Data and manifest become visible
together, so a run that dies in between loads the same files again instead of losing or doubling
them. Files that disappear keep what was loaded from them. A file with a broken row or an unknown
column does not keep the sound ones from being loaded; it is reported and tried again next time.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerline.operators import local_frame
from careerline.sources.files import ALGORITHM, discover, fingerprint
from careerline.sources.records import read_quoted_csv, split_states
from careerline.sources.warehouse import Warehouse, side_by_side

MANIFEST = "raw/manifest"
MANIFEST_SCHEMA = (
    "source_file string, entity string, file_hash string, row_count long, path string, length long, modified long, loaded_at timestamp"
)
LINEAGE = ("_source_file", "_file_hash", "_loaded_at")
OUTCOMES = ("skipped", "loaded", "reloaded")
FILES_PER_READ = 10_000


def raw_table(entity: str) -> str:
    return f"raw/raw_{entity}"


def plan_load(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` with the outcome the load will have for each."""
    known = manifest.select("source_file", F.col("file_hash").alias("_known_hash"))
    outcome = (
        F.when(F.col("_known_hash").isNull(), "loaded")
        .when(F.col("_known_hash") == F.col("file_hash"), "skipped")
        .otherwise("reloaded")
    )
    return (
        files.join(known, "source_file", "left")
        .withColumn("outcome", outcome)
        .drop("_known_hash")
    )


def summarise(plan: DataFrame) -> DataFrame:
    """Number of files per outcome, zeros included."""
    spark = plan.sparkSession
    every = local_frame(spark, [(o,) for o in OUTCOMES], "outcome string")
    counted = plan.groupBy("outcome").agg(F.count("*").alias("files"))
    return every.join(counted, "outcome", "left").fillna(0, ["files"])


def upsert_manifest(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """The manifest with the rows of ``loaded`` in place of older ones of the same file."""
    return manifest.join(loaded.select("source_file"), "source_file", "left_anti").unionByName(
        loaded
    )


def conform(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``frame`` with exactly ``columns``: a missing one is NULL, an extra one is an error."""
    extra = [c for c in frame.columns if c not in columns]
    if extra:
        raise ValueError(f"columns not in the table: {extra}")
    missing = F.lit(None).cast("string")
    present = set(frame.columns)
    return frame.select(
        *[F.col(f"`{c}`") if c in present else missing.alias(c) for c in columns]
    )


def header_columns(header: str) -> list[str]:
    return next(csv.reader([header]))


def read_text_csv(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str],
    whole: bool = True,
    broken: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Every column as text. All ``paths`` must have the same header.

    Spark assigns CSV columns by position, so files with other headers need a read of their own.
    ``whole`` allows line ends inside quotes, which makes a file a single task; files without such
    line ends are read in splits, and most of the others by :func:`read_quoted_csv`. Broken rows are
    an error, or kept in the column ``broken``. ``exact`` tells an empty text in quotes from an empty
    field, which alone is NULL then, and keeps NUL characters in quotes; the load takes both empties for NULL.
    """
    names = [*columns, broken] if broken else columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    reader = spark.read.option("columnNameOfCorruptRecord", broken) if broken else spark.read
    if exact:
        # Spark's own marker of NULL is the empty text; one made for this read stands in no file.
        reader = reader.option("nullValue", f"null-{uuid.uuid4().hex}")
        # Its default, NUL, is dropped inside quotes.
        reader = reader.option("charToEscapeQuoteEscaping", '"')
    return (
        reader.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE" if broken else "FAILFAST")
        .option("multiLine", whole)
        .option("escape", '"')
        .csv(list(paths))
    )


@dataclass(frozen=True)
class Source:
    """A file to load and how it is read: by ``lines``, in ``splits`` that put their records together, or ``whole``."""

    name: str
    path: str
    file_hash: str
    header: str
    route: str


def routed(spark: SparkSession, files: Sequence[Row]) -> list[Source]:
    """``files`` (rows of ``fingerprint``) with the way to read them."""
    quoted = [f["path"] for f in files if f["quoted_newline"]]
    unfit = split_states(spark, quoted)[1] if quoted else set()
    route = lambda f: "lines" if not f["quoted_newline"] else "whole" if f["path"] in unfit else "splits"
    return [Source(f["source_file"], f["path"], f["file_hash"], f["header"], route(f)) for f in files]


def _reads(spark: SparkSession, files: Sequence[Source], broken: str | None = None) -> list[tuple[list[str], DataFrame]]:
    """One read per header and route: the columns of the files, and their rows with ``_source_file``."""
    reads = []
    for header, route in dict.fromkeys((f.header, f.route) for f in files):
        paths = [f.path for f in files if (f.header, f.route) == (header, route)]
        columns = header_columns(header)
        if route == "splits":
            rows = read_quoted_csv(spark, paths, columns, "_source_file", broken)
        else:
            text = read_text_csv(spark, paths, columns, route == "whole", broken)
            rows = text.select("*", F.col("_metadata.file_name").alias("_source_file"))
        reads.append((columns, rows))
    return reads


def _text_of(spark: SparkSession, files: Sequence[Source], columns: Sequence[str]) -> DataFrame:
    """All rows of ``files`` (same entity, any header) with lineage."""
    named = [conform(rows, [*columns, "_source_file"]) for _, rows in _reads(spark, files)]
    hashes = local_frame(spark, [(f.name, f.file_hash) for f in files], "_source_file string, _file_hash string")
    # at most FILES_PER_READ rows
    joined = reduce(DataFrame.unionByName, named).join(F.broadcast(hashes), "_source_file", "left")
    return joined.select(*columns, "_source_file", "_file_hash", F.current_timestamp().alias("_loaded_at"))


class LoadError(ValueError):
    """Files that could not be loaded, and why. All others were."""

    def __init__(self, failed: dict[str, str], outcomes: dict[str, int]) -> None:
        super().__init__("; ".join(f"{name}: {why}" for name, why in sorted(failed.items())))
        self.failed, self.outcomes = failed, outcomes


def _broken_files(spark: SparkSession, files: Sequence[Source]) -> set[str]:
    """Names of the files with a row that does not fit their header."""
    found: set[str] = set()
    for columns, text in _reads(spark, files, broken="_broken"):
        # Reading every column keeps the parser from overlooking a ragged row.
        rows = text.groupBy("_source_file").agg(
            F.count("_broken").alias("broken"),
            F.max(F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("read"),
        )
        found |= {r["_source_file"] for r in rows.collect() if r["broken"]}  # one row per file
    return found


def _load_entity(
    warehouse: Warehouse, entity: str, files: list[Row]
) -> tuple[dict[str, int], dict[str, str]]:
    """Replace the parts of ``files``; returns rows per file and what is wrong with the others."""
    table = raw_table(entity)
    if warehouse.exists(table):
        columns = [c for c in warehouse.columns(table) if c not in LINEAGE]
    else:
        columns = header_columns(files[0]["header"])
    failed = {}
    for f in files:
        extra = [c for c in header_columns(f["header"]) if c not in columns]
        if extra:
            failed[f["source_file"]] = f"columns not in {table}: {extra}"
    sound = routed(warehouse.spark, [f for f in files if f["source_file"] not in failed])
    if not sound:
        return {}, failed
    try:
        return _load_files(warehouse, table, sound, columns), failed
    except (PySparkException, Py4JJavaError):
        broken = _broken_files(warehouse.spark, sound)
        if not broken:
            raise
    # A stray quote misleads only those who count quotes.
    in_doubt = [replace(f, route="whole") for f in sound if f.name in broken and f.route == "splits"]
    sound = [f for f in sound if f.name not in broken]
    if in_doubt:
        broken -= {f.name for f in in_doubt}
        misled = _broken_files(warehouse.spark, in_doubt)
        broken |= misled
        sound += [f for f in in_doubt if f.name not in misled]
    failed |= dict.fromkeys(broken, "malformed rows")
    return (_load_files(warehouse, table, sound, columns) if sound else {}), failed


def _load_files(
    warehouse: Warehouse, table: str, files: list[Source], columns: Sequence[str]
) -> dict[str, int]:
    text = reduce(
        DataFrame.unionByName,
        [
            _text_of(warehouse.spark, files[start : start + FILES_PER_READ], columns)
            for start in range(0, len(files), FILES_PER_READ)
        ],
    )
    names = [f.name for f in files]
    return warehouse.replace_parts(table, text, F.col("_source_file"), names)


def read_manifest(warehouse: Warehouse) -> DataFrame:
    if warehouse.exists(MANIFEST):
        return warehouse.read(MANIFEST)
    return warehouse.spark.createDataFrame([], MANIFEST_SCHEMA)


def unmodified(files: Sequence[Row], manifest: DataFrame) -> set[str]:
    """Names of the files that have the path, length and time of modification they were loaded with."""
    known = manifest.where(F.col("file_hash").startswith(f"{ALGORITHM}:")).select("source_file", "path", "length", "modified")
    seen = {tuple(r) for r in known.collect()}  # one row per file
    return {f["source_file"] for f in files if (f["source_file"], f["path"], f["length"], f["modified"]) in seen}


def ingest(
    warehouse: Warehouse, source_dir: str, min_year: int = 1990, rehash: bool = False
) -> dict[str, int]:
    """Load what is new or changed below ``source_dir``; returns files per outcome.

    Files are compared by content; those that were not modified since they were loaded are not read
    again for it, unless ``rehash`` asks for that. Raises :class:`LoadError` when all sound files are loaded and published, if others are not.
    """
    spark = warehouse.spark
    files = discover(spark, source_dir, min_year).collect()  # one row per file
    if not files:
        raise ValueError(f"no source files found in {source_dir}")
    manifest = read_manifest(warehouse)
    same = set() if rehash else unmodified(files, manifest)
    read = [f for f in files if f["source_file"] not in same]
    plan = plan_load(fingerprint(spark, read), manifest).collect() if read else []
    changed = sorted((f for f in plan if f["outcome"] != "skipped"), key=lambda f: f["path"])
    failed: dict[str, str] = {}
    if changed:
        by_entity = {
            e: [f for f in changed if f["entity"] == e] for e in {f["entity"] for f in changed}
        }
        loads = [partial(_load_entity, warehouse, e, files) for e, files in by_entity.items()]
        with warehouse.publishing():
            results = side_by_side(loads)
            counts = {name: n for rows, _ in results for name, n in rows.items()}
            failed = {name: why for _, wrong in results for name, why in wrong.items()}
            loaded = [f for f in changed if f["source_file"] in counts]
            if loaded:
                _record(warehouse, manifest, loaded, counts)
    outcomes = _tally([*("skipped" for _ in same), *(f["outcome"] for f in plan if f["source_file"] not in failed)])
    if failed:
        raise LoadError(failed, outcomes)
    return outcomes


def _record(
    warehouse: Warehouse, manifest: DataFrame, changed: list[Row], counts: dict[str, int]
) -> None:
    rows = [
        (f["source_file"], f["entity"], f["file_hash"], counts[f["source_file"]], f["path"], f["length"], f["modified"])
        for f in changed
    ]
    loaded = local_frame(
        warehouse.spark, rows, MANIFEST_SCHEMA.removesuffix(", loaded_at timestamp")
    ).withColumn("loaded_at", F.current_timestamp())
    warehouse.replace(MANIFEST, upsert_manifest(manifest, loaded))


def _tally(outcomes: Iterable[str]) -> dict[str, int]:
    found = list(outcomes)
    return {o: found.count(o) for o in OUTCOMES}
