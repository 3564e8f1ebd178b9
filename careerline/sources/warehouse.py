"""Parquet tables that become visible together.

Every write goes to a folder of its own. One small table, the pointer, tells the folders that are in force; ``publish`` replaces it
by one with the new folders, so a run that dies before leaves everything as it was. A table is one folder or a set of parts
(seasons, source files) that are replaced one by one. One writer at a time is meant, whose threads may write different
tables. Folders that no pointer names are left to the owner of the root folder.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerline.operators.local import local_frame
from careerline.sources.footers import footer_session, row_count

POINTER_SCHEMA = "turn long, table_name string, part string, folder string, columns string"
WHOLE, THREADS = "", 4
Result = TypeVar("Result")
PLAIN_NAME = re.compile(r"[\w.\-]+")


def side_by_side(steps: Sequence[Callable[[], Result]]) -> list[Result]:
    """Run independent steps from a few threads, so that their Spark jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=THREADS) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


class Warehouse:
    """Tables named ``layer/name`` below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._open()

    def _open(self) -> None:
        self._turn, self._opened = self._published()
        self._tables = dict(self._opened)
        self._written: set[str] = set()

    def _published(self) -> tuple[int, dict[str, tuple[str, dict[str, str | None]]]]:
        """The newest pointer: per table its columns, and its folders by part. Two folders hold
        pointers in turn, so one of them is complete at any time."""
        found = []
        for slot in (0, 1):
            try:
                found.append(self.spark.read.schema(POINTER_SCHEMA).parquet(f"{self.root}/pointer-{slot}").collect())  # a row per part
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        rows = max((x for x in found if x), key=lambda x: x[0]["turn"], default=[])
        tables: dict[str, tuple[str, dict]] = {r["table_name"]: (r["columns"], {}) for r in rows}
        for r in rows:
            tables[r["table_name"]][1][r["part"]] = r["folder"]
        return (rows[0]["turn"] if rows else 0), tables

    def exists(self, table: str) -> bool:
        return table in self._tables

    def columns(self, table: str) -> list[str]:
        return T.StructType.fromJson(json.loads(self._tables[table][0])).names

    def parts(self, table: str) -> list[str]:
        """Parts that hold rows."""
        return [p for p, folder in self.snapshot(table) if folder]

    def snapshot(self, table: str) -> list[tuple[str, str | None]]:
        """Parts and their folders: the same for as long as nothing of the table is written."""
        return sorted(self._tables[table][1].items()) if self.exists(table) else []

    def read(self, table: str, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows in force, of all parts or of the named ones only."""
        return self._read(self.spark, table, parts)

    def read_footers(self, table: str, parts: Iterable[str] | None = None) -> DataFrame:
        """:meth:`read` for counts and extremes of whole parts, which are taken from the files' footers.

        An extreme needs a value in every file. The frame belongs to a session of its own: collect it, don't join it.
        """
        return self._read(footer_session(self.spark), table, parts)

    def row_count(self, table: str) -> int:
        return row_count(self.read_footers(table))

    def _read(self, spark: SparkSession, table: str, parts: Iterable[str] | None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._tables[table][0]))
        wanted = None if parts is None else set(parts)
        folders = [folder for p, folder in self.snapshot(table) if folder and (wanted is None or p in wanted)]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def replace(self, table: str, frame: DataFrame) -> DataFrame:
        """Make ``frame`` the whole content of ``table``; this session sees it at once, others after ``publish``."""
        folder = self._new_folder(table)
        frame.write.parquet(folder)
        self._now(table, frame.schema, {WHOLE: folder})
        return self.read(table)

    def replace_parts(self, table: str, frame: DataFrame, part: Column, parts: Iterable[str], rebalance: bool = False, drop: Sequence[str] = ()) -> dict[str, int]:
        """Replace ``parts`` by the rows of ``frame``, without the columns ``drop``; returns the number of rows of each.

        A part without rows ends up empty; parts that are not named stay untouched. ``rebalance`` evens out the
        files: small parts are put together and a part that holds most rows is split over several tasks.
        """
        wanted = sorted(parts)
        if bad := [name for name in wanted if not PLAIN_NAME.fullmatch(name)]:
            raise ValueError(f"{bad[0]!r} cannot name a part of {table}")
        folder = self._new_folder(table)
        tagged = frame.withColumn("_part", part.cast("string")).drop(*drop)
        (tagged.hint("rebalance", F.col("_part")) if rebalance else tagged).write.partitionBy("_part").parquet(folder)
        stored = footer_session(self.spark).read.schema(T.StructType().add("_part", "string")).parquet(folder)
        rows = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}
        if unexpected := sorted(set(rows) - set(wanted)):
            raise ValueError(f"rows of unnamed parts of {table}: {unexpected[:5]}")
        now = {p: f"{folder}/_part={p}" if p in rows else None for p in wanted}
        self._now(table, tagged.drop("_part").schema, {**dict(self.snapshot(table)), **now})
        return {p: rows.get(p, 0) for p in wanted}

    def _new_folder(self, table: str) -> str:
        if table in self._written:
            raise ValueError(f"{table} is written already; publish first")
        return f"{self.root}/{table}/{uuid.uuid4().hex}"

    def _now(self, table: str, schema: T.StructType, parts: dict[str, str | None]) -> None:
        self._written.add(table)
        self._tables[table] = (schema.json(), parts)

    def publish(self) -> None:
        """Make everything written since the last call visible, in one step."""
        if not self._written:
            return
        turn, published = self._published()
        if moved := sorted(t for t in self._written if published.get(t) != self._opened.get(t)):
            raise RuntimeError(f"published by another writer in the meantime: {moved}")
        tables = {**published, **{t: self._tables[t] for t in self._written}}
        rows = [(turn + 1, t, p, folder, columns) for t, (columns, parts) in tables.items() for p, folder in parts.items()]
        local_frame(self.spark, rows, POINTER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pointer-{(turn + 1) % 2}")
        self._open()

    @contextmanager
    def publishing(self) -> Iterator[None]:
        """Publish what the block writes, or none of it when the block fails."""
        try:
            yield
        except BaseException:
            self._open()
            raise
        self.publish()
