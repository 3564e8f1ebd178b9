"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerline.llm.rows import column, unwrapped, wrapped
from careerline.llm.storage import stored

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (5, 2, 1)
#: No source is read more often than this.
MAX_EPOCHS = 3
SEED = 20_24
#: Words of a document that are sent at a time.
PACKET = 64
#: Documents that one slice of a source holds on average.
SLICE = 4096
WORD = r"[^\x20\x09-\x0D]+"
WORD_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    """Words of a text; zero for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, the place of each source by code point, NULL last; no task holds all of them."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    per_part = ranged.groupBy("part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    per_part = per_part.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    joined = ranged.withColumn("inside", inside).join(per_part, F.col("part") == F.col("of"))
    return joined.withColumn("rank", F.col("ahead") + F.col("inside")).drop("part", "of", "ahead", "inside")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: int | None = None, epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` in words from the words per source.

    Names are ranked by code point, NULL last, and weighed by the repeating ``weights``. A target stops at
    ``epochs`` times the size; the excess is shared again by weight, in a few rounds of which three sums reach the driver.
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(given, (F.col("rank") % len(weights)).cast("int"))
    ranked = _ranked(sizes.select("source", "source_size"))
    none = F.when(F.col("source_size") <= 0, F.lit(0.0))
    state = stored(ranked.select("source", "source_size", weight.alias("weight"), none.alias("target")))
    left = float(state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] if budget is None else budget)
    while True:
        open_ = state.where("target IS NULL")
        total = open_.agg(F.sum("weight")).first()[0]
        if total is None:
            break
        share = F.lit(max(left, 0.0)) * F.col("weight") / F.lit(total)
        full = share >= epochs * F.col("source_size")
        words, count = open_.agg(F.coalesce(F.sum(F.when(full, epochs * F.col("source_size"))), F.lit(0)), F.count_if(full)).first()
        settled = F.when(full, (epochs * F.col("source_size")).cast("double")) if count else share
        state = stored(state.withColumn("target", F.coalesce("target", settled)))
        left -= float(words)
    return state.select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    budget: int | None = None,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    rows_per_slice: int = SLICE,
    packet: int = PACKET,
) -> DataFrame:
    """How many words of each document the mix takes, and where the mix reads it first.

    Every source is a queue of its shuffled documents, read again from the start up to ``epochs`` times. Its words are
    sent in packets: a document's words, at most ``packet`` at a time. The virtual finish time of a packet is the number of
    words of its queue up to its end, divided by the source's target. The packets of all queues are range-sorted by
    finish time, and the mix takes them until their words reach the total budget. So each source comes
    near its target: no queue is ahead of the others by more than a packet.

    Returns ``key``, ``size``, ``source``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and
    ``position`` (words read before it is first read; NULL if it is not taken). Documents without
    words are never taken. NULL sources are one source, NULL texts have no words, rows with
    equal keys are documents of their own, and no rows give no rows.
    """
    sized = docs.select(column(key).alias("key"), column(source).alias("source"), word_count(column(text)).alias("size"))
    # Ties of the shuffle are broken by key and size; rows that tie in all are alike.
    sized = stored(sized.withColumn("place", F.xxhash64(F.lit(seed), "key", "size")))
    per_source = stored(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    )
    targets = stored(source_targets(per_source, weights, budget, epochs))
    queued = _queue(sized, per_source, targets, rows_per_slice)
    sources, words = per_source.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget = words if budget is None else budget
    copies = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    packets = copies.withColumn("packet", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / packet).cast("int") - 1)))
    start = F.col("before") + F.col("epoch") * F.col("source_size") + F.col("packet") * packet
    sent = packets.withColumn("start", start).withColumn("words", F.least(F.lit(packet), F.col("size") - F.col("packet") * packet))
    # At the virtual time 1 every queue is within a packet of its target, so a queue sends what the others are short of at most after it.
    sent = sent.where(F.col("start") < F.col("target") + F.lit(packet) * F.lit(sources))
    sent = sent.withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))
    left = F.lit(budget) - F.col("position")
    served = _positions(sent).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left)))
    per_row = served.groupBy("row").agg(
        F.sum("taken").alias("taken"), F.min(F.when(F.col("taken") > 0, F.col("position"))).alias("position")
    )
    columns = [F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target"]
    return queued.join(per_row, "row", "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position")


def _queue(sized: DataFrame, per_source: DataFrame, targets: DataFrame, rows_per_slice: int) -> DataFrame:
    """Adds ``before``, the words of the same queue ahead of each document.

    Each source is cut into slices of its shuffle order, as many as its documents need.
    The words of whole slices are added up over one row per slice, so no task holds a source.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_slice)).alias("slices")
    known = per_source.select("source", slices).join(
        targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    )
    known = stored(known.select(F.col("source").alias("of"), "slices", "source_size", "target"))
    dealt = sized.join(known, sized["source"].eqNullSafe(known["of"])).drop("of")
    # The sign bit is dropped so that slices follow the shuffle order.
    order = F.shiftrightunsigned("place", 1)
    dealt = dealt.withColumn("place", order).withColumn(
        "slice", F.floor(order / F.lit(float(1 << 63)) * F.col("slices")).cast("long")
    )
    per_slice = dealt.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(
        F.col("source").alias("of"), F.col("slice").alias("at"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")
    )
    inside = (
        Window.partitionBy("source", "slice").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(per_slice, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    joined = joined.withColumn("before", F.col("ahead") + F.col("inside"))
    named = joined.select("key", "size", "source", "source_size", "target", "place", "before")
    return stored(named.withColumn("row", F.monotonically_increasing_id()))


def _positions(served: DataFrame) -> DataFrame:
    """``row``, ``words`` and ``position`` of every packet in the global order of virtual finish times.

    The range sort is stored with its partition numbers; the words of whole partitions are
    added up over one row per partition, and inside a partition row by row.
    """
    order = ["finish", "source", "place", "row", "epoch", "packet"]
    ranged = served.select("row", "epoch", "packet", "source", "place", "finish", "words").repartitionByRange(*order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
    per_part = ranged.groupBy("part").agg(F.sum("words").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    joined = placed.join(per_part, F.col("part") == F.col("of"))
    return joined.select("row", "words", (F.col("ahead") + F.col("inside")).alias("position"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False, **options) -> DataFrame:
    """``docs`` as often as the mix takes them; the last, cut reading of a document holds its first words only.

    With ``whole`` that reading holds the whole text, so a source may exceed its target by the rest of one document.

    Rows that repeat a key share what the mix takes of that key. The columns stay those of ``docs``.
    """
    found = mix(docs, key, text, source, **options)
    per_key = found.groupBy(F.col(key).alias("of")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("sizes"))
    rows = wrapped(docs, key=key, text=text)
    joined = rows.join(per_key.where("taken > 0"), F.col("key").eqNullSafe(F.col("of")))
    times = F.ceil(F.col("taken") / F.col("sizes")).cast("int")
    read = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    share = F.col("taken") / F.col("sizes") - (F.col("copy") - 1)
    count = F.round(share * word_count(F.col("text"))).cast("int")
    # Every piece is a word and the white space after it; white space ahead of all is a piece of its own.
    pieces = F.split("text", WORD_START, -1)
    leading = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    first_words = F.array_join(F.slice(pieces, F.lit(1), count + leading), "")
    part = F.when(share > 0 if whole else share >= 1, F.col("text")).when(count > 0, first_words)
    return unwrapped(read.withColumn("part", part).where("part IS NOT NULL"), docs.columns, **{text: F.col("part")})
