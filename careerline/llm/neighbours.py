"""Approximate nearest neighbours: a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerline.llm.storage import stored

NEAREST = 20
TREES = 16
#: Rows that the trees are fitted on, at most; every row is indexed.
SAMPLE = 16_384
#: Rows of the whole table that a leaf should hold, as far as the sample allows.
LEAF_ROWS = 100
#: Sampled rows that a leaf holds at least.
LEAF_SAMPLE = 8
#: Leaves are searched until they hold this share of the rows, counted once per tree.
SEARCH_SHARE = 0.6
#: And at least so many rows, counted once per tree; small tables need a larger share.
SEARCH_ROWS = 12_000
#: A leaf's rows and a leaf's queries in one task; larger ones are cut.
CELL_ROWS = 4096
SEED = 11
_SLACK = 1e-9


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth. Node ``k`` has the children ``2 k + 1`` (projection up to ``bounds``) and ``2 k + 2``."""

    normals: np.ndarray  # trees x nodes x dimensions
    bounds: np.ndarray  # trees x nodes
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees."""
        out = np.empty((len(rows), len(self.normals)), np.int64)
        at = np.arange(len(rows))
        for tree, (normals, bounds) in enumerate(zip(self.normals, self.bounds, strict=True)):
            sides = rows @ normals.T > bounds
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + sides[at, node]
            out[:, tree] = node - (self.leaves - 1) + tree * self.leaves
        return out

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell the sum of the squared margins by which its path leaves the query's side."""
        found = []
        for normals, bounds in zip(self.normals, self.bounds, strict=True):
            margins = queries @ normals.T - bounds
            so_far = np.zeros((len(queries), 1))
            for level in range(self.depth):
                here = margins[:, (1 << level) - 1 : (2 << level) - 1]
                below = so_far + np.square(np.maximum(here, 0))
                above = so_far + np.square(np.maximum(-here, 0))
                so_far = np.stack([below, above], axis=2).reshape(len(queries), -1)
            found.append(so_far)
        return np.concatenate(found, axis=1)

    def visits(self, queries: np.ndarray, sizes: np.ndarray, budget: float) -> list[np.ndarray]:
        """Per query the cells that one queue over all trees gives, nearest first, until they hold ``budget`` rows.

        Margins only add up on the way down, so the order of the leaves is that in which a shared
        priority queue would release them. Empty leaves are passed over.
        """
        filled = np.flatnonzero(sizes)
        distances = self.distances(queries)[:, filled]
        order = np.argsort(distances, axis=1, kind="stable")
        reached = np.cumsum(sizes[filled][order], axis=1)
        ends = (reached < budget).sum(axis=1) + 1
        return [filled[row[:end]] for row, end in zip(order, ends, strict=True)]


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = SEED) -> Forest:
    """Each node projects on the difference of two of its sampled rows and cuts at the median."""
    rng = np.random.default_rng(seed)
    nodes, dims = (1 << depth) - 1, sample.shape[1]
    normals, bounds = np.zeros((trees, nodes, dims)), np.zeros((trees, nodes))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = members.pop(node)
            normal = np.zeros(dims)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                normal = sample[a] - sample[b]
            if not normal.any():
                normal = rng.standard_normal(dims)
            normal /= np.linalg.norm(normal)
            projected = sample[rows] @ normal
            bound = float(np.median(projected)) if len(rows) else 0.0
            normals[tree, node], bounds[tree, node] = normal, bound
            members[2 * node + 1], members[2 * node + 2] = rows[projected <= bound], rows[projected > bound]
    return Forest(normals, bounds, depth)


# --- tables ---------------------------------------------------------------------------------


def usable(vector: Column, dims: int) -> Column:
    """Neither NULL nor zero, of ``dims`` finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.size(vector) == dims) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(packed: pd.Series, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(-1, dims).astype(np.float64)


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """One more component makes all rows equally long, so that the largest product is the least distance."""
    rest = np.sqrt(np.maximum(longest - np.square(rows).sum(axis=1), 0.0))
    return np.column_stack([rows, rest])


def _scorer(dims: int, kind: str, nearest: int):
    """Streams cells: a cell's rows come first and are held, its queries are scored as they come."""

    def best(ids: np.ndarray, rows: np.ndarray, frame: pd.DataFrame) -> pd.DataFrame:
        queries, asked = _matrix(frame["vector"], dims, kind), frame["id"].to_numpy()
        scores = queries @ rows.T
        scores[asked[:, None] == ids[None, :]] = -np.inf
        least = frame["least"].to_numpy()
        if len(ids) > nearest:
            top = np.partition(scores, len(ids) - nearest, axis=1)[:, len(ids) - nearest]
            least = np.maximum(least, top)
        q, r = np.nonzero((scores >= least[:, None] - _SLACK) & (scores > -np.inf))
        # The scores that count are summed row by row, so equal rows have equal scores in every cell.
        exact = (queries[q] * rows[r]).sum(axis=1)
        return pd.DataFrame({"query_id": asked[q], "vec_id": ids[r], "score": exact})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, rows = None, np.empty(0, np.int64), np.empty((0, dims))
        for frame in frames:
            keys = frame[["cell", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = []
            for part in np.split(np.arange(len(frame)), cuts):
                if not len(part):
                    continue
                group, key = frame.iloc[part], tuple(keys[part[0]])
                if key != held:
                    held, ids, rows = key, np.empty(0, np.int64), np.empty((0, dims))
                is_query = group["is_query"].to_numpy()
                if not is_query.all():
                    indexed = group[~is_query]
                    ids = np.concatenate([ids, indexed["id"].to_numpy()])
                    rows = np.concatenate([rows, _matrix(indexed["vector"], dims, kind)])
                if is_query.any() and len(ids):
                    asked = group[is_query]
                    found += [best(ids, rows, asked.iloc[k : k + 512]) for k in range(0, len(asked), 512)]
            if found:
                yield pd.concat(found)

    return run


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    search_share: float = SEARCH_SHARE,
    search_rows: int = SEARCH_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the rows with the largest inner products.

    Queries are the rows for which ``is_query`` holds; every other usable row is a candidate, and so are
    other queries. Vectors that are NULL, zero or hold NULL or non-finite components, and those of another length than most,
    take no part. Ties go to the smaller key. Rows that repeat a key count as one, with
    the best of their scores. Fewer candidates than ``nearest`` are all returned; no usable vector gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("is_query"))
    named = named.where("id IS NOT NULL")
    lengths = named.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    dims = common["dims"]
    kind = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"
    rows = named.where(usable(F.col("vector"), dims))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total = rows.agg(F.count("*").alias("n"), F.max(squares).alias("longest")).first()
    if not total["n"]:
        return spark.createDataFrame([], result)
    n, longest = total["n"], total["longest"]

    # The sample is bounded by a parameter; the trees fitted on it are broadcast.
    chosen = rows.select("id", "vector").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample).collect()
    sampled = np.array([r["vector"] for r in chosen], np.float64)
    most = max(1, min(n // leaf_rows, len(sampled) // LEAF_SAMPLE))
    depth = most.bit_length() - 1
    forest = fit_forest(_lifted(sampled, longest), trees, depth)
    shared = spark.sparkContext.broadcast((forest, sampled, np.array([r["id"] for r in chosen])))

    def cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                matrix = np.stack([np.asarray(v, kind) for v in frame["vector"]])
                cells = shared.value[0].cells(_lifted(matrix.astype(np.float64), longest))
                packed = [row.tobytes() for row in matrix]
                yield pd.DataFrame({"id": frame["id"], "is_query": frame["is_query"], "vector": packed, "cells": list(cells)})

    asks = F.coalesce("is_query", F.lit(False)).alias("is_query")
    indexed = stored(
        rows.select("id", asks, "vector").mapInPandas(cells_of, "id long, is_query boolean, vector binary, cells array<long>")
    )
    # At most one row per leaf of the forest.
    counted = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(trees * forest.leaves, np.int64)
    sizes[[r["cell"] for r in counted]] = [r["n"] for r in counted]
    budget = max(search_share * n, float(search_rows))
    deep = 3 * nearest

    def visits_of(bounded: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest, sampled, sampled_ids = shared.value
            for frame in frames:
                for at in range(0, len(frame), 256):
                    part = frame.iloc[at : at + 256]
                    matrix = _matrix(part["vector"], dims, kind)
                    lifted = np.column_stack([matrix, np.zeros(len(matrix))])
                    cells = forest.visits(lifted, sizes, budget)
                    least = np.full(len(part), -np.inf)
                    if bounded and len(sampled) > deep:
                        # What many sampled rows exceed cannot be among the nearest.
                        scores = matrix @ sampled.T
                        scores[part["id"].to_numpy()[:, None] == sampled_ids[None, :]] = -np.inf
                        least = np.partition(scores, len(sampled) - deep, axis=1)[:, len(sampled) - deep]
                    yield pd.DataFrame({"id": part["id"], "vector": part["vector"], "least": least, "cells": cells})

        return run

    def search(queries: DataFrame, bounded: bool) -> DataFrame:
        schema = "id long, vector binary, least double, cells array<long>"
        found = queries.select("id", "vector").mapInPandas(visits_of(bounded), schema)
        asked = stored(found).select("id", "vector", "least", F.explode("cells").alias("cell"))
        stocked = indexed.select("id", "vector", F.lit(None).cast("double").alias("least"), F.explode("cells").alias("cell"))
        cut = _cuts(sizes, asked, cell_rows)
        # Row parts meet query parts: a row goes to every part of the queries, a query to every part of the rows.
        last = lambda name: F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1)
        own = lambda name: F.pmod(F.xxhash64("id"), F.coalesce(name, F.lit(1))).cast("int")
        stocked = stocked.join(cut, "cell", "left").withColumn("i", own("row_parts")).withColumn("j", F.explode(last("query_parts")))
        asked = asked.join(cut, "cell", "left").withColumn("j", own("query_parts")).withColumn("i", F.explode(last("row_parts")))
        columns = ["cell", "i", "j", "is_query", "id", "vector", "least"]
        both = stocked.withColumn("is_query", F.lit(False)).select(columns).unionByName(
            asked.withColumn("is_query", F.lit(True)).select(columns)
        )
        keys = ["cell", "i", "j"]
        dealt = both.repartition(*keys).sortWithinPartitions(*keys, "is_query")
        scored = dealt.mapInPandas(_scorer(dims, kind, nearest), "query_id long, vec_id long, score double")
        merged = scored.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return merged.withColumn("rank", ranked).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

    queries = indexed.where("is_query")
    found = stored(search(queries, True))
    # A query whose bound was too high for what its leaves hold is searched without one.
    enough = min(nearest, indexed.select("id").distinct().count() - 1)
    counts = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    short = queries.join(counts, queries["id"] == counts["query_id"], "left_anti")
    if enough > 0 and not short.isEmpty():
        full = found.join(counts.select("query_id"), "query_id", "left_semi")
        found = full.unionByName(search(short, False))
    return found


def _cuts(sizes: np.ndarray, asked: DataFrame, cell_rows: int) -> DataFrame:
    """Parts of the rows and of the queries of cells that have too many for one task; one row per leaf at most."""
    spark = asked.sparkSession
    large = spark.createDataFrame(
        [(int(k), int(-(-sizes[k] // cell_rows))) for k in np.flatnonzero(sizes > cell_rows)], "cell long, row_parts int"
    )
    busy = asked.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("query_parts")).where("query_parts > 1")
    cut = large.join(busy, "cell", "full").select("cell", F.coalesce("row_parts", F.lit(1)).alias("row_parts"), F.coalesce("query_parts", F.lit(1)).alias("query_parts"))
    return F.broadcast(cut)
