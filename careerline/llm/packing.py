"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerline.llm.rows import unwrapped, wrapped
from careerline.llm.storage import stored
from careerline.llm.tokens import document_ids

CAPACITY = 1024
#: Documents that are packed together; every block is a problem of its own.
BLOCK = 4096
#: Populations of a block that evolve apart and hand each other their best packings.
ISLANDS = 3
#: Times that the islands evolve; elites migrate in between.
EPOCHS = 2
GENERATIONS = 8
POPULATION = 6
#: Bins filled to this share stay as they are when the rest of all blocks is packed anew.
WELL_FILLED = 0.98
SEED = 97
#: Tasks of one epoch, at most; a task may have several islands.
MOST_TASKS = 20_000
#: Room for the bins of a block in a sequence number.
_BINS_PER_BLOCK = 1 << 24


# --- pieces of documents -------------------------------------------------------------------


def token_pieces(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """The token pieces of whole documents: key, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    Only documents longer than ``capacity`` are cut, into full pieces behind a first one that may
    be shorter. ``row`` numbers the rows of ``docs``, so documents with equal keys stay apart.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"row long, `{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if keep_ids else ""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0].strip("`") for part in schema.split(", ")]
        for frame in frames:
            found = []
            for row, name, body in zip(frame["row"], frame["key"], frame["text"], strict=True):
                coded = memoryview(document_ids(body, vocabulary)).cast("B")
                total = len(coded) // 4
                first = (total - 1) % capacity + 1
                cuts = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    ids = coded[4 * a : 4 * b]
                    found.append((row, name, k, a, b - a, zlib.crc32(ids), *([bytes(ids)] if keep_ids else [])))
            yield pd.DataFrame(found, columns=names)

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInPandas(pieces, schema)


# --- one block ------------------------------------------------------------------------------


def best_fit(order: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, in the given order, into the fullest bin with room for them, or into a new one."""
    at_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for k, members in enumerate(bins):
        room = capacity - sum([sizes[i] for i in members])
        if room:
            at_room.setdefault(room, []).append(k)
            rooms |= 1 << room
    for item in order:
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            same = at_room[room]
            k = same.pop()
            if not same:
                rooms ^= 1 << room
            bins[k].append(item)
            room -= size
        else:
            k, room = len(bins), capacity - size
            bins.append([item])
        if room:
            at_room.setdefault(room, []).append(k)
            rooms |= 1 << room
    return bins


class Islander:
    """Packings of one block: lists of bins, each a list of item numbers."""

    def __init__(self, sizes: list[int], capacity: int, rng: np.random.Generator) -> None:
        self.sizes, self.capacity, self.rng = sizes, capacity, rng
        self.least = -(-sum(sizes) // capacity)

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first; then fuller and emptier bins before evenly filled ones."""
        fills = [sum([self.sizes[i] for i in members]) for members in bins]
        return len(bins), -sum([f * f for f in fills]) / self.capacity**2

    def _falling(self, items: list[int], noise: float = 0.0) -> list[int]:
        sizes = np.array([self.sizes[i] for i in items], float)
        if noise:
            sizes *= 1 + noise * self.rng.standard_normal(len(items))
        return [items[k] for k in np.argsort(-sizes, kind="stable")]

    def founder(self, noise: float) -> list[list[int]]:
        items = list(range(len(self.sizes)))
        return best_fit(self._falling(items, noise), self.sizes, [], self.capacity)

    def child(self, mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        """The mother with whole well-filled bins of the father.

        Mother's bins that share an item with them go, and so do some of the emptiest of the rest;
        their other items are displaced and fitted best into what is left.
        """
        fill = lambda members: sum([self.sizes[i] for i in members])
        ranked = sorted(father, key=fill, reverse=True)
        ranked = ranked[: max(1, len(ranked) // 2)]
        chosen = self.rng.random(len(ranked)) < 0.5
        injected = [list(members) for members, take in zip(ranked, chosen, strict=True) if take]
        taken = bytearray(len(self.sizes))
        for members in injected:
            for i in members:
                taken[i] = 1
        kept, displaced = [], []
        for members in mother:
            if any([taken[i] for i in members]):
                displaced += [i for i in members if not taken[i]]
            else:
                kept.append(list(members))
        kept.sort(key=fill)
        loose = min(len(kept), 2 + int(self.rng.integers(0, 1 + len(kept) // 20)))
        displaced += [i for members in kept[:loose] for i in members]
        return best_fit(self._falling(displaced, 0.02), self.sizes, injected + kept[loose:], self.capacity)

    def evolve(self, population: list[list[list[int]]], generations: int, keep: int) -> list[list[list[int]]]:
        """The best ``keep`` packings, best first. Ends when no packing can have fewer bins."""
        ranked = sorted(population, key=self.cost)[:keep]
        for _ in range(generations):
            if len(ranked[0]) <= self.least:
                break
            children = []
            for _ in range(max(2, keep // 2)):
                mother, father = self.rng.choice(len(ranked), 2)
                children.append(self.child(ranked[mother], ranked[father]))
            ranked = sorted([*ranked, *children], key=self.cost)[:keep]
        return ranked


def _genes(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of each item."""
    found = np.empty(n, np.int32)
    for k, members in enumerate(bins):
        found[members] = k
    return found


def _bins(genes: np.ndarray) -> list[list[int]]:
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.diff(genes[order])) + 1
    return [part.tolist() for part in np.split(order, cuts)] if len(genes) else []


# --- all blocks -----------------------------------------------------------------------------

_STATE = "block long, island int, sizes array<int>, population array<array<int>>, bins int"


def _evolution(capacity: int, generations: int, population: int, seed: int, epoch: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame.itertuples():
            sizes = np.asarray(row.sizes, int).tolist()
            rng = np.random.default_rng([seed, epoch, int(row.block), int(row.island)])
            islander = Islander(sizes, capacity, rng)
            packings = [_bins(np.asarray(genes)) for genes in (row.population if row.population is not None else [])]
            if not packings:
                # Island 0 starts with the plain best fit by falling size.
                packings = [islander.founder(0.0 if k == row.island == 0 else 0.03 * (1 + k)) for k in range(population)]
            packings = islander.evolve(packings, generations, population)
            genes = [_genes(p, len(sizes)) for p in packings]
            out.append((row.block, row.island, np.asarray(sizes, np.int32), genes, len(packings[0])))
        return pd.DataFrame(out, columns=["block", "island", "sizes", "population", "bins"])

    return run


def pack_items(
    items: DataFrame,
    capacity: int = CAPACITY,
    block: int = BLOCK,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    seed: int = SEED,
) -> DataFrame:
    """``item``, ``block``, ``bin``, ``offset`` and ``fill`` for items of ``length`` from 1 to ``capacity``.

    Items are dealt by hash into blocks of about ``block``, so memory is bounded however many there are.
    Per block, each island is one row and one task group. After each epoch an island gets the best
    packing of its neighbour; at the end the best packing of all islands counts.
    """
    n = items.count()
    blocks = max(1, -(-n // block))
    dealt = items.select(
        F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(blocks)).alias("block"), F.struct((-F.col("length")).alias("less"), "item").alias("x")
    )
    listed = dealt.groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    listed = stored(
        listed.select("block", F.col("x.item").alias("items"), F.transform("x.less", lambda v: (-v).cast("int")).alias("sizes"))
    )
    state = listed.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        "sizes",
        F.lit(None).cast("array<array<int>>").alias("population"),
    )
    for epoch in range(epochs):
        evolve = _evolution(capacity, generations, population, seed, epoch)
        # An island is a small row and much work, so each gets a task instead of being coalesced by size.
        dealt_out = state.repartition(min(blocks * islands, MOST_TASKS), "block", "island")
        evolved = stored(dealt_out.groupBy("block", "island").applyInPandas(evolve, _STATE))
        # The elite of each island joins the population of the next one.
        elite = evolved.select(
            "block",
            F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
            F.slice("population", 1, 1).alias("elite"),
        )
        state = evolved.join(elite, ["block", "island"]).select(
            "block", "island", "sizes", F.concat("population", "elite").alias("population")
        )
    best = evolved.groupBy("block").agg(
        F.min_by(F.struct(F.col("population")[0].alias("genes")), F.struct("bins", "island")).alias("best")
    )
    chosen = listed.join(best, "block").select(
        "block", F.explode(F.arrays_zip("items", "sizes", F.col("best.genes").alias("genes"))).alias("x")
    )
    placed = chosen.select("block", F.col("x.genes").alias("bin"), F.struct(F.col("x.items").alias("item"), F.col("x.sizes").alias("length")).alias("x"))
    return _offsets(placed)


def _offsets(placed: DataFrame) -> DataFrame:
    """A bin's items in order of their numbers; a bin holds at most as many items as its capacity."""
    bins = placed.groupBy("block", "bin").agg(F.sort_array(F.collect_list("x")).alias("x"))
    before = F.transform(
        F.col("x"),
        lambda v, k: F.struct(
            v["item"].alias("item"),
            v["length"].alias("length"),
            F.aggregate(F.slice("x", F.lit(1), k), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("offset"),
        ),
    )
    fill = F.aggregate("x", F.lit(0).cast("long"), lambda a, y: a + y["length"])
    return bins.select("block", "bin", fill.alias("fill"), F.explode(before).alias("x")).select(
        "block", "bin", "fill", "x.item", "x.length", "x.offset"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, well_filled: float = WELL_FILLED, **options) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (replaced if there are such) to rows that have ``length`` from 1 to ``capacity``.

    A row of full length is a sequence of its own. The others are packed block by block; then the
    items of bins that are not well filled are dealt anew over fewer blocks and packed again, which is kept if
    it takes fewer bins. Other lengths are an error.
    """
    rows = wrapped(pieces, length="length")
    numbered = stored(rows.withColumn("item", F.monotonically_increasing_id()))
    wrong = numbered.where(F.col("length").isNull() | ~F.col("length").between(1, capacity))
    if not wrong.isEmpty():
        raise ValueError(f"lengths have to be from 1 to {capacity}")
    short = numbered.where(F.col("length") < capacity).select("item", "length")
    first = stored(pack_items(short, capacity, **options))
    loose = F.col("fill") < int(well_filled * capacity)
    again = stored(pack_items(first.where(loose).select("item", "length"), capacity, **options))
    count = lambda packed: packed.select("block", "bin").distinct().count()
    chosen = first
    if count(again) < count(first.where(loose)):
        # Blocks of the second round have negative numbers.
        chosen = first.where(~loose).unionByName(again.withColumn("block", -F.col("block") - 1))
    sequence = (F.col("block") * F.lit(_BINS_PER_BLOCK) + F.col("bin")) * 2
    placed = chosen.select(F.col("item").alias("of"), sequence.alias("sequence_id"), "offset")
    joined = numbered.join(placed, F.col("item") == F.col("of"), "left")
    return unwrapped(
        joined,
        [c for c in pieces.columns if c not in ("sequence_id", "offset")],
        # Odd numbers are sequences of one full row.
        F.coalesce("sequence_id", F.col("item") * 2 + 1).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False, **options) -> DataFrame:
    """Packs all documents; one row per piece (see :func:`token_pieces` and :func:`pack`).

    NULL and empty texts are one id, the end of the document. Rows with equal or NULL keys are packed as they
    are. An empty table gives no rows.
    """
    return pack(token_pieces(docs, vocabulary, key, text, options.get("capacity", CAPACITY), keep_ids), **options).drop("row")
