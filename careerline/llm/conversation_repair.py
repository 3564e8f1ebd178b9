"""Conversation structure repair: the cheapest edits that give every conversation sound roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.llm.role_grammar import (
    BATCH, CLOSING, STATES, actions, closing_cost, spelled, transfer_matrices,
)
from careerline.llm.rows import column
from careerline.llm.storage import stored

WHITE_SPACE = " \t\n\x0b\f\r"
#: Binary digits of a segment's length: a longer conversation is repaired in segments whose matrices are combined.
SEGMENT_BITS = 10
_LEGAL = {"su", "ua", "au"}
_EVALUATED = "key string, start long, marks string, costs array<int>, audits array<string>, illegal long, first string, last string"
_SETTLED = "key string, start long, audit string, cost long, illegal long, blank long, duplicate long, truncated long, rows array<string>"
ROLE_NAMES = {"u": "user", "a": "assistant"}


def key_of(conv_id: Column) -> Column:
    """A text that is never NULL; a NULL id is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _or_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` with faults that depend on a row's id and turn only.

    By crc32 of ``conv_id:turn``, modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats the
    row, 4 makes it the user's. NULL roles and texts become one space, NULL ids and turns count as one space.
    """
    fault = F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))) % 20
    text, role = _or_space(F.col("text")), _or_space(F.col("role"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return rows.drop("col")


def _ordered(rows: DataFrame) -> DataFrame:
    """Every row without its text: its place in the order of all rows and, repeats aside, its mark.

    A range sort deals the rows, so a long conversation lies in many partitions; rows that are equal throughout
    are dealt by a number of their own.
    """
    trimmed = F.rtrim("text", F.lit(WHITE_SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    light = rows.select(
        "key",
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(trimmed == "", "b").when(whole, F.upper(kind)).otherwise(kind).alias("mark"),
        F.monotonically_increasing_id().alias("own"),
    )
    order = ["key", "turn", "role", "digest", "own"]
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.drop("own").withColumn("place", F.monotonically_increasing_id()))


def _marked(ordered: DataFrame) -> DataFrame:
    """``ordered`` with the mark ``d`` for rows whose role and text their conversation has had before."""
    said = ordered.where("mark <> 'b'")
    same = ["key", "role", "digest"]
    repeated = said.groupBy(*same).agg(F.min("place").alias("earliest"), F.count("*").alias("times")).where("times > 1")
    mark = F.when(F.col("place") > F.col("earliest"), "d").otherwise(F.col("mark")).alias("mark")
    columns = ["key", "role", "place"]
    return said.join(repeated, same, "left").select(*columns, mark).unionByName(ordered.where("mark = 'b'").select(*columns, "mark"))


def _evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each segment's costs and audits between all states. Equal segments are evaluated once, and
    the rules that different ones share as well."""

    def results(part: pd.DataFrame) -> pd.DataFrame:
        distinct = list(dict.fromkeys(part["marks"]))
        table = {}
        for marks, matrix in zip(distinct, transfer_matrices(distinct), strict=True):
            entries = [x for row in matrix for x in row]
            table[marks] = [-1 if x is None else x[0] for x in entries], ["" if x is None else spelled(x[1]) for x in entries]
        inside = [sum(a + b not in _LEGAL for a, b in zip(x, x[1:], strict=False)) for x in part["initials"]]
        return pd.DataFrame({
            "key": part["key"], "start": part["start"], "marks": part["marks"],
            "costs": [table[x][0] for x in part["marks"]], "audits": [table[x][1] for x in part["marks"]],
            "illegal": inside, "first": part["initials"].str[0], "last": part["initials"].str[-1],
        })

    for batch in batches:
        group = batch["marks"].str.len().cumsum() // BATCH
        for _, part in batch.groupby(group, sort=False):
            yield results(part)


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cheapest way through the segments of each conversation, which come in order.

    Costs to the end are added up from the last segment to the first, then the states at the borders
    are chosen from the first to the last. A conversation's audit is one text, so its segments fit a task too.
    """

    def settled(segments: list[tuple]) -> Iterator[tuple]:
        ahead = [[closing_cost(k) for k in range(STATES)]]
        for _, _, _, costs, *_ in reversed(segments):
            options = lambda i: [costs[i * STATES + k] + ahead[-1][k] for k in range(STATES) if costs[i * STATES + k] >= 0]  # noqa: B023, E731
            ahead.append([min(options(i), default=1 << 60) for i in range(STATES)])
        ahead.reverse()
        state, before = 0, None
        for n, (key, start, marks, costs, audits, illegal, first, last) in enumerate(segments):
            ways = [(costs[state * STATES + k] + ahead[n + 1][k], audits[state * STATES + k], k) for k in range(STATES) if costs[state * STATES + k] >= 0]
            _, audit, chosen = min(ways)
            cost, is_last = costs[state * STATES + chosen], n == len(segments) - 1
            rows, state = actions(audit, marks, state, is_last)
            if is_last:
                audit, cost = audit + "I" * len(CLOSING[state]), cost + closing_cost(state)
            border = before is not None and before + first not in _LEGAL
            yield (key, start, audit, cost, illegal + border, marks.count("b"), marks.count("d"), sum(map(marks.count, "suao")), rows)
            before = last

    names = [c.split()[0] for c in _SETTLED.split(", ")]
    held: list[tuple] = []
    for batch in batches:
        done: list[tuple] = []
        for segment in batch.itertuples(index=False, name=None):
            if held and held[0][0] != segment[0]:
                done.extend(settled(held))
                held = []
            held.append(segment)
        if done:
            yield pd.DataFrame(done, columns=names)
    if held:
        yield pd.DataFrame(list(settled(held)), columns=names)


def plan(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """The stored order of all rows, and per segment its share of the cheapest edits.

    ``rows`` has ``key``, ``conv_id``, ``turn``, ``role`` and ``text``, none of the last two NULL.
    """
    ordered = _ordered(rows)
    initial = F.substring("role", 1, 1)
    row = F.struct("place", "mark", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    segments = (
        _marked(ordered)
        .groupBy("key", F.shiftright("place", segment_bits).alias("segment"))
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select(
            "key",
            F.get("rows", F.lit(0))["place"].alias("start"),
            F.array_join(F.transform("rows", lambda r: r["mark"]), "").alias("marks"),
            F.array_join(F.transform("rows", lambda r: r["initial"]), "").alias("initials"),
        )
    )
    evaluated = segments.mapInPandas(_evaluate, _EVALUATED)
    return ordered, stored(evaluated.repartition("key").sortWithinPartitions("key", "start").mapInPandas(_settle, _SETTLED))


def repaired(rows: DataFrame, ordered: DataFrame, settled: DataFrame) -> DataFrame:
    """``key``, ``conv_id``, ``place``, ``step``, ``edit``, ``role`` and ``text`` of the repaired conversations' rows.

    ``edit`` is ``K`` (kept), ``R`` (new role) or ``I`` (inserted); a conversation's order is that of ``place`` and ``step``.
    Texts meet their edits by conversation and digest, once for all rows that are equal.
    """
    edits = settled.select("start", F.posexplode("rows").alias("offset", "edits"))
    steps = edits.select(
        (F.col("start") + F.col("offset")).alias("place"),
        F.posexplode(F.regexp_extract_all("edits", F.lit("[IKR][sua]"), F.lit(0))).alias("step", "edit"),
    )
    texts = rows.groupBy("key", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.any_value("text").alias("text"))
    placed = steps.join(ordered.select("key", "conv_id", "place", "role", "digest"), "place")
    edit, named = F.substring("edit", 1, 1), F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    said = placed.join(texts, ["key", "digest"])
    return said.select(
        "key",
        "conv_id",
        "place",
        "step",
        edit.alias("edit"),
        F.when(edit == "K", F.col("role")).otherwise(F.try_element_at(named, F.substring("edit", 2, 1))).alias("role"),
        F.when(edit == "I", "").otherwise(F.col("text")).alias("text"),
    )


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, which come in order; one hash is held, never a conversation."""
    key, running = None, None
    for batch in batches:
        done = []
        for next_key, line in zip(batch["key"], batch["line"], strict=True):
            if running is None or next_key != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = next_key, hashlib.sha256(line.encode())
            else:
                running.update(b"\n" + line.encode())
        if done:
            yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
    if running is not None:
        yield pd.DataFrame([(key, running.hexdigest())], columns=["key", "repaired_sha256"])


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_bits: int = SEGMENT_BITS
) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (see :func:`repaired`) and a report per conversation.

    Rows are taken by turn, NULL turns first, ties by role and the SHA-256 of the text. The first fault of a row counts: blank, duplicate
    (role and text occurred earlier) or truncated (the text does not end with ``.``, ``!`` or ``?``). Blank and duplicate rows are deleted, any
    other row is kept, gets the role user or assistant, or is deleted, and empty rows are inserted, such that the roles' initials match
    ``(s?(ua)+)?`` at the least cost; among equal costs the audit, the edits' initials in order, is the least.

    The report has ``conv_id`` (under its given name), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``key``.
    NULL roles and texts are one space, rows with a NULL id are one conversation, other columns are ignored, no rows give no rows.
    Conversations are dealt in segments of at most ``2 ** segment_bits`` rows, so none lies in one task with its texts.
    """
    rows = conversations.select(
        key_of(column(conv_id)).alias("key"),
        column(conv_id).alias("conv_id"),
        column(turn).alias("turn"),
        _or_space(column(role)).alias("role"),
        _or_space(column(text)).alias("text"),
    )
    ordered, settled = plan(rows, segment_bits)
    turns = ordered.groupBy("key", "turn").agg(F.first("conv_id").alias("conv_id"))
    gaps = turns.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    whole = settled.groupBy("key").agg(*sums, F.sort_array(F.collect_list(F.struct("start", "audit"))).alias("parts"))
    report = gaps.join(whole, "key").select(
        F.col("conv_id").alias(conv_id), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"), "key",
    )
    return repaired(rows, ordered, settled), report


def digests(conversations: DataFrame) -> DataFrame:
    """Every original conversation's report on the repair of its :func:`damaged` rows, and the SHA-256 of the repaired ones.

    The lines ``role:text`` of a conversation are hashed in order, as SHA-256 must; a task holds one batch of them at a time.
    """
    rows, report = repair(damaged(conversations))
    lines = rows.select("key", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("key").sortWithinPartitions("key", "place", "step").select("key", "line")
    hashed = dealt.mapInPandas(_digest, "key string, repaired_sha256 string")
    ids = conversations.groupBy("conv_id").agg(F.count("*").alias("rows")).select("conv_id", key_of(F.col("conv_id")).alias("key"))
    found = ids.join(report.drop("conv_id"), "key", "left").join(hashed, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
