"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerline.llm.storage import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per left node the smallest node among itself and its partners, as a stored table.

    Both sides of the join that follows are then plain shuffles, which adaptive execution
    can split when one node has a large share of the links.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return stored(least.select("u", F.least("u", "m").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    joined = both.join(_smallest(both), "u").where("v > u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = down.join(_smallest(down), "u")
    moved = joined.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = joined.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return own.unionByName(moved).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached, for every linked node.

    Links are undirected; loops, repeats and links with a NULL end are ignored, and no link
    gives an empty result. Only the number of links and a checksum reach the driver.
    """
    ordered = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
    )
    links = stored(ordered.distinct())
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        links = stored(_small_star(stored(_large_star(links))))
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
