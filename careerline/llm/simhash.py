"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerline.llm.components import connected_components
from careerline.llm.rows import column, unwrapped, wrapped
from careerline.llm.storage import stored

SHINGLE = 4
RADIUS = 4
#: Fingerprints that one tile holds; larger groups are cut into tiles.
TILE = 4096
HASH_SEED = 42
_BLOCK = 256
_CHUNK = 1 << 16
_TILE_ID = 1 << 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; a text without words has fingerprint zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]
    stops = ends[width - 1 :] - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), stops[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprint_column(text: str, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed ``long`` with the same bits."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(x, shingle) for x in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return prints(column(text))


def _merge(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the trees of linked rows; afterwards every row points at its smallest row."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def tile_forest(prints: np.ndarray, second: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a tile (or two tiles) connects: fewer than there are rows.

    Rows are compared by exclusive-or and bit count, block by block in order of their
    population count; blocks whose counts differ beyond the radius are skipped.
    ``second`` marks the rows of the second tile; only rows of different tiles are compared.
    """
    ones = np.bitwise_count(prints)
    order = np.argsort(ones, kind="stable")
    prints, ones = prints[order], ones[order].astype(np.int64)
    rows = columns = np.arange(len(prints))
    if second is not None:
        rows, columns = np.flatnonzero(~second[order]), np.flatnonzero(second[order])
    parent = np.arange(len(prints))
    for at in range(0, len(rows), _BLOCK):
        block = rows[at : at + _BLOCK]
        low = ones[block[0]] - radius
        first = np.searchsorted(ones[columns], low) if second is not None else at
        last = np.searchsorted(ones[columns], ones[block[-1]] + radius, side="right")
        near = columns[first:last]
        if not len(near):
            continue
        linked = np.bitwise_count(prints[block][:, None] ^ prints[near][None, :]) <= radius
        i, j = np.nonzero(linked)
        i, j = block[i], near[j]
        keep = i != j
        if keep.any():
            _merge(parent, i[keep], j[keep])
    moved = np.flatnonzero(parent != np.arange(len(prints)))
    return prints[moved], prints[parent[moved]]


def _tile_links(radius: int):
    """Streams rows sorted by tile; a tile that spans two Arrow batches is carried over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["band", "value", "lo", "hi"]

        def links(frame: pd.DataFrame, starts: np.ndarray, stops: np.ndarray) -> pd.DataFrame:
            prints = frame["fp"].to_numpy().view(np.uint64)
            tile, lo, hi = (frame[x].to_numpy() for x in ("tile", "lo", "hi"))
            found = []
            for a, b in zip(starts, stops, strict=True):
                second = None if lo[a] == hi[a] else tile[a:b] == hi[a]
                found.append(tile_forest(prints[a:b], second, radius))
            left, right = (np.concatenate([x[k] for x in found] or [np.empty(0, np.uint64)]) for k in (0, 1))
            return pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})

        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            frame = pd.concat([*held, frame], ignore_index=True)
            columns = frame[keys].to_numpy()
            cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
            starts = np.concatenate(([0], cuts))
            held = [frame.iloc[starts[-1] :]]
            stops = np.append(cuts, len(frame))
            more = (stops - starts)[:-1] > 1
            yield links(frame, starts[:-1][more], stops[:-1][more])
        if held and len(held[0]) > 1:
            rest = held[0].reset_index(drop=True)
            yield links(rest, np.array([0]), np.array([len(rest)]))

    return run


def _bands(fp: Column, radius: int) -> Column:
    """``radius + 1`` parts of the 64 bits: fingerprints within the radius agree in one of them."""
    parts = radius + 1
    cuts = [64 * k // parts for k in range(parts + 1)]
    return F.array(
        *(
            F.struct(
                F.lit(k).alias("band"),
                F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"),
            )
            for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))
        )
    )


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` that connect what lies within the radius.

    Each fingerprint goes to the tile of each of its bands. A band value with more than ``tile``
    fingerprints is cut into tiles by population count and hash, and its rows go to every
    pair of tiles whose counts are within the radius, so that no task holds the whole group. A tile returns
    a spanning forest instead of all its pairs.
    """
    if not 0 <= radius <= 15:
        raise ValueError("the radius must be from 0 to 15 bits")
    keyed = prints.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.explode(_bands(F.col("fp"), radius)).alias("b"))
    keyed = keyed.select("fp", "ones", "b.band", "b.value")
    sizes = keyed.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    # At most radius + 1 times 2^(64 / (radius + 1) + 1) groups, and one per tile of fingerprints.
    large = (
        sizes.groupBy("band", "value")
        .agg(
            F.sum("n").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).alias("tiles")))).alias("tiles"),
        )
        .where(F.col("n") > tile)
        .select("band", "value", "tiles")
    )
    rows = keyed.join(large, ["band", "value"], "left")
    part = F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("ones")))
    own = F.when(F.col("tiles").isNull(), F.lit(0).cast("long")).otherwise(F.col("ones") * F.lit(_TILE_ID) + part)
    near = F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("ones")) <= radius)
    others = F.flatten(
        F.transform(near, lambda e: F.transform(F.sequence(F.lit(0).cast("long"), e["value"] - 1), lambda s: e["key"] * F.lit(_TILE_ID) + s))
    )
    rows = rows.withColumn("tile", own)
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long")))))
    tiles = rows.select(
        "band", "value", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp"
    )
    keys = ["band", "value", "lo", "hi"]
    sorted_tiles = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_tiles.mapInPandas(_tile_links(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """``key``, ``fp`` and ``component`` (smallest key that links reach) for every row of ``docs``.

    NULL, empty and blank texts have fingerprint zero and are linked like any other; texts with
    fewer words than a shingle are one shingle. Rows with equal keys are kept as they are. A
    NULL key is never the smallest of a component that has others. An empty table gives none.
    """
    prints = stored(docs.select(column(key).alias("id"), fingerprint_column(text, shingle).alias("fp")))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    members = stored(connected_components(fingerprint_links(classes, radius, tile), "a", "b"))
    linked = members.join(classes, members["node"] == classes["fp"])
    smallest = linked.groupBy("component").agg(F.min("first").alias("smallest"))
    moved = members.join(smallest, "component").select(F.col("node").alias("fp"), "smallest")
    classes = stored(
        classes.join(moved, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component"))
    )
    return prints.join(classes, "fp").select(F.col("id").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, with all their columns.

    Of rows that repeat a key the first by text stays. Rows with a NULL key stay only where a
    component has no other key.
    """
    found = stored(near_duplicates(docs, key, text, **options))
    chosen = found.select(F.col("component").alias("kept")).distinct()
    rows = wrapped(docs, key=key, text=text)
    # An equality on the key itself: the window below reads the same shuffle.
    kept = rows.join(chosen, F.col("key") == F.col("kept"), "left_semi")
    if not chosen.where("kept IS NULL").isEmpty():
        kept = kept.unionByName(rows.where("key IS NULL"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("text").asc_nulls_first()))
    return unwrapped(kept.withColumn("place", place).where("place = 1"), docs.columns)
