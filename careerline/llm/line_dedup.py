"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.llm.rows import column, unwrapped, wrapped
from careerline.llm.storage import stored

#: A line on more than this share of a host's pages is boilerplate.
MAX_RATIO = 0.05
#: A line is repeated from this many pages on.
MIN_PAGES = 2
#: Standard deviations by which a line's pages must exceed what a line at the ratio has on average: a sample as small as
#: the host shows with 99 % confidence that its share is larger.
CONFIDENCE = 2.33
#: Boilerplate lines (about 32 bytes each) up to which their table is broadcast.
BROADCAST_LINES = 200_000
#: Parts into which the pages of a host are dealt when the table is too large to broadcast.
SALTS = 64


def _line_key(line: Column) -> Column:
    """Two hashes of the trimmed line, 128 bits in all."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("h"), F.xxhash64(F.lit("line"), trimmed).alias("g"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(
    docs: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, confidence: float = CONFIDENCE
) -> DataFrame:
    """``host`` and ``line`` (hash pair) of every line on more than ``max_ratio`` of its host's pages.

    The rule is one for every size of host: a line on at least two of ``n`` pages is boilerplate if it is on more than
    ``n * max_ratio + confidence * sqrt(n * max_ratio * (1 - max_ratio))`` of them. For large hosts that is the ratio; of a few pages a
    line must be on more than chance brings together, and a line on every page of a host always goes. A line counts once a page. Counts are combined before the shuffle, so a host with a large share of all
    pages sends one row per line and task.
    """
    pages = docs.select(column(host).alias("host"), column(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _line_key)
    on_pages = (
        pages.select("host", F.explode(F.array_distinct(keys)).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("on_pages"))
        .where(F.col("on_pages") >= MIN_PAGES)
    )
    totals = totals.withColumnRenamed("host", "of")
    joined = on_pages.join(totals, F.col("host").eqNullSafe(F.col("of")))
    spread = F.sqrt(F.col("pages") * F.lit(max_ratio) * F.lit(1 - max_ratio))
    return joined.where(F.col("on_pages") > F.col("pages") * F.lit(max_ratio) + F.lit(confidence) * spread).select("host", "line")


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    confidence: float = CONFIDENCE,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` without the boilerplate lines of their hosts, and the column ``dropped_lines`` (replaced if there is one).

    Lines are cut at ``\\n`` and compared without spaces at their ends; blank lines are never
    boilerplate. Rows with a NULL host form one host. A NULL text stays NULL, a text that loses
    every line becomes empty, and a row is never dropped. Repeated rows are pages of their own.
    """
    flagged = stored(boilerplate_lines(docs, host, text, max_ratio, confidence))
    per_host = flagged.groupBy("host").agg(F.collect_list("line").alias("flagged")).withColumnRenamed("host", "of")
    pages = wrapped(docs, host=host, text=text)
    same_host = F.col("host").eqNullSafe(F.col("of"))
    if flagged.count() <= broadcast_lines:
        joined = pages.join(F.broadcast(per_host), same_host, "left")
    else:
        # Each part of a host's pages meets its own copy of the host's lines.
        dealt = pages.withColumn("salt", F.pmod(F.xxhash64("host", "text"), F.lit(SALTS)).cast("int"))
        copies = per_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(copies, same_host & (F.col("salt") == F.col("part")), "left")
    lines = _lines(F.col("text"))
    here = F.array_intersect(F.transform(lines, _line_key), "flagged")
    kept = F.filter(lines, lambda x: ~F.array_contains("here", _line_key(x)))
    cleaned = joined.withColumn("here", here)
    has_any = F.size("here") > 0
    lost = F.when(has_any, F.size(lines) - F.size(kept)).otherwise(0).alias("dropped_lines")
    left = F.when(has_any, F.array_join(kept, "\n")).otherwise(F.col("text"))
    columns = [c for c in docs.columns if c != "dropped_lines"]
    return unwrapped(cleaned, columns, lost, **{text: left})
