"""Comparisons between entities: at the same point of a career, and head to head."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerline.operators.joins import small_side
from careerline.operators.local import local_frame


def cohort_pairs(
    members: DataFrame,
    cohort: str,
    pairings: Sequence[tuple[str, str]],
    anchor: Mapping[str, str],
    compared: Mapping[str, str],
) -> DataFrame:
    """Every anchor next to itself and next to each member of the cohorts it is compared with.

    ``pairings`` lists (anchor cohort, compared cohort); both lookups are equi joins on the
    cohort name. ``anchor`` and ``compared`` map output columns to member columns.
    """
    with_self = [(first, None) for first in dict.fromkeys(first for first, _ in pairings)]
    rules = local_frame(
        members.sparkSession, [*pairings, *with_self], f"{cohort} string, _other string"
    )
    anchors = members.join(F.broadcast(rules), cohort)
    left = [F.col(c).alias(n) for n, c in anchor.items()]
    right = [F.col(c).alias(n) for n, c in compared.items()]
    with_itself = anchors.where(F.col("_other").isNull()).select(*left, *right)
    others = members.select(F.col(cohort).alias("_other"), *right)
    with_others = anchors.select("_other", *left).join(others, "_other").drop("_other")
    return with_itself.unionByName(with_others)


def counts_up_to_point(
    pairs: DataFrame,
    pair_rows: int,
    events: DataFrame,
    key: str,
    point: str,
    limit: str,
    counts: Mapping[str, Column] | None = None,
    amounts: Sequence[str] = (),
) -> DataFrame:
    """Per pair, how many events of ``key`` lie at or before the pair's ``limit``.

    ``counts`` maps output columns to conditions; ``amounts`` names whole-number columns that are added
    up, for events that were counted before. A pair without an event gets zeros.
    Events are summed per (key, point) and added up in order of their points, and each pair reads
    the running totals at its limit: the work grows with the events and the pairs, not with their
    product. ``pair_rows`` is a proven upper bound of the grid; events of keys that no pair
    has are left out before anything is shuffled if it is small.
    """
    counts = counts or {}
    names = [*counts, *amounts]
    sums = [F.count_if(condition).alias(name) for name, condition in counts.items()]
    sums += [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in amounts]
    wanted = small_side(pairs.select(key).distinct(), pair_rows)
    tallies = (
        events.where(F.col(point).isNotNull())
        .join(wanted, key, "left_semi")
        .groupBy(F.col(key).alias("_key"), F.col(point).alias("_at"))
        .agg(*sums)
        .withColumn("_pair", F.lit(None).cast(pairs.schema))
    )
    asked = pairs.select(
        F.col(key).alias("_key"),
        F.col(limit).alias("_at"),
        *[F.lit(0).cast("long").alias(name) for name in names],
        F.struct(*pairs.columns).alias("_pair"),
    )
    so_far = (
        Window.partitionBy("_key")
        .orderBy(F.col("_at").asc_nulls_first(), F.col("_pair").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = [F.sum(name).over(so_far).alias(name) for name in names]
    return (
        tallies.unionByName(asked)
        .select("_pair", *totals)
        .where(F.col("_pair").isNotNull())
        .select("_pair.*", *names)
    )


def head_to_head(
    events: DataFrame,
    own: DataFrame,
    own_rows: int,
    own_key: str,
    other: DataFrame,
    other_rows: int,
    other_key: str,
    group: Sequence[str],
    counts: Mapping[str, Column],
) -> DataFrame:
    """Counts of the meetings of two cohorts. Both sides are joined before anything is shuffled."""
    return (
        events.join(small_side(own, own_rows), own_key)
        .join(small_side(other, other_rows), other_key)
        .groupBy(*group)
        .agg(*[F.count_if(condition).alias(name) for name, condition in counts.items()])
    )


def ordered_list(item: str, *order: str) -> Column:
    """``item`` texts joined with a comma in the given order (nulls last)."""
    keys = ", ".join(f"{o} asc nulls last" for o in order)
    return F.expr(f"listagg({item}, ', ') within group (order by {keys})")
