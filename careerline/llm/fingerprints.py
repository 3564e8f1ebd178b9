"""Document fingerprints from modular prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerline.operators import heavy_hitters

#: Two primes below 2^31: a product of two residues fits 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
#: A fingerprint samples from this many to twice as many prefixes, and suffixes.
CELLS = 16
#: Code points of the windows whose hashes choose where a text is cut into spans.
WINDOW = 8
#: A text is cut where a window's hash is less than those of so many windows before and after it.
RADIUS = 32
#: Bytes of text that a range of keys is meant to hold, ranges for each shuffle partition at least, and most ranges.
RANGE_BYTES = 64 << 20
RANGES_PER_PARTITION = 4
MOST_RANGES = 32_768
_CHUNK = 1 << 16


@cache
def _powers(prime: int, base: int) -> np.ndarray:
    found = np.ones(1, np.uint64)
    while len(found) < _CHUNK:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), prime)) % np.uint64(prime)])
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def prefix_hashes(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """``h[k]``, the hash of the first ``k`` code points, for ``k`` from 0 to the length.

    ``h[k]`` is the sum of ``(codes[i] + 1) * base^i`` modulo the prime; one pass of array
    operations for every 65,536 code points.
    """
    prime, base = PRIMES[which], BASES[which]
    powers, modulus = _powers(prime, base), np.uint64(prime)
    out = np.zeros(len(codes) + 1, np.uint64)
    total, shift = 0, 1
    for at in range(0, len(codes), _CHUNK):
        part = codes[at : at + _CHUNK].astype(np.uint64) + np.uint64(1)
        terms = np.cumsum(part * powers[: len(part)] % modulus) % modulus
        found = (terms * np.uint64(shift) + np.uint64(total)) % modulus
        out[at + 1 : at + 1 + len(part)] = found
        total, shift = int(found[-1]), shift * pow(base, _CHUNK, prime) % prime
    return out


def span_hash(prefix: np.ndarray, start: int, stop: int, which: int = 0) -> int:
    """The hash of ``codes[start:stop]``, whatever its place: equal spans have equal hashes."""
    prime, base = PRIMES[which], BASES[which]
    return (int(prefix[stop]) - int(prefix[start])) * pow(base, -start, prime) % prime


def span_hashes(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int = 0) -> np.ndarray:
    """:func:`span_hash` of many spans."""
    prime = PRIMES[which]
    back, modulus = pow(BASES[which], -1, prime), np.uint64(prime)
    chunks = range(len(prefix) // _CHUNK + 1)
    scales = np.array([pow(back, k * _CHUNK, prime) for k in chunks], np.uint64)
    found = (prefix[stops] + modulus - prefix[starts]) % modulus
    return found * _powers(prime, back)[starts % _CHUNK] % modulus * scales[starts // _CHUNK] % modulus


def cuts(prefix: np.ndarray) -> np.ndarray:
    """Where a text is cut into spans: the ends of windows whose hash is a strict minimum around them.

    What surrounds a place alone decides whether it is cut, so equal passages are cut alike wherever they stand.
    Two cuts are more than ``RADIUS`` apart; a text that repeats itself within that distance is not cut.
    """
    count = len(prefix) - 1 - WINDOW
    if count <= 0:
        return np.empty(0, np.int64)
    starts = np.arange(count)
    hashes = span_hashes(prefix, starts, starts + WINDOW).astype(np.uint32)
    beyond = np.full(RADIUS, 0xFFFF_FFFF, np.uint32)
    least, width = np.concatenate([beyond, hashes, beyond]), 1
    while width < RADIUS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.flatnonzero((hashes < least[:count]) & (hashes < least[RADIUS + 1 :])) + WINDOW


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int, which: int = 0) -> int:
    """How far the texts of two prefix arrays agree from positions ``i`` and ``j`` on: a binary search
    over the length of equal spans."""
    low, high = 0, min(len(a) - 1 - i, len(b) - 1 - j)
    while low < high:
        middle = (low + high + 1) // 2
        if span_hash(a, i, i + middle, which) == span_hash(b, j, j + middle, which):
            low = middle
        else:
            high = middle - 1
    return low


def _step(n: int) -> int:
    """Distance of the sampled prefixes: a power of two, so that the longer of two grids is part of the shorter."""
    return 1 << max(0, n.bit_length() - CELLS.bit_length())


def fingerprint(text: str | None) -> str:
    """Length, hash of the whole text, then sampled prefix and suffix hashes and all spans, in hexadecimal.

    The prefixes of lengths ``step, 2 step, ...`` and suffixes of the same lengths are sampled with 31 bits
    each; the whole text has 62 bits. The spans between :func:`cuts` follow each other without gaps, each with 31 bits
    and its length; they take about a sixth of the text's length.
    """
    codes = code_points(text or "")
    n, step = len(codes), _step(len(codes))
    first = prefix_hashes(codes)
    whole = int(first[-1]) << 31 | int(prefix_hashes(codes, 1)[-1])
    prefixes = first[step::step]
    # The suffix of length k step starts step further left than the one before.
    starts = np.arange(n - step, -1, -step)
    prime = PRIMES[0]
    suffixes = (first[-1] + np.uint64(prime) - first[starts]) % np.uint64(prime)
    back = pow(BASES[0], -1, prime)
    scale, by, scales = pow(back, n - step, prime) if n >= step else 1, pow(BASES[0], step, prime), []
    for _ in range(len(starts)):
        scales.append(scale)
        scale = scale * by % prime
    suffixes = suffixes * np.array(scales, np.uint64) % np.uint64(prime)
    ladder = lambda hashes: "".join([f"{x:08x}" for x in hashes.tolist()])
    bounds = np.concatenate([[0], cuts(first), [n]])
    hashes = span_hashes(first, bounds[:-1], bounds[1:])
    spans = "-".join([f"{x:08x}{size:x}" for x, size in zip(hashes.tolist(), np.diff(bounds).tolist(), strict=True)])
    return f"{n:x}.{whole:016x}.{ladder(prefixes)}.{ladder(suffixes)}.{spans}"


def _agreeing(a: str, step_a: int, b: str, step_b: int) -> int:
    """Length of the longest sampled prefix (or suffix) of two texts that agrees, by binary search."""
    step = max(step_a, step_b)
    by_a, by_b = 8 * step // step_a, 8 * step // step_b
    low, high = 0, min(len(a) // by_a, len(b) // by_b)
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle * by_a - 8 : middle * by_a] == b[middle * by_b - 8 : middle * by_b]:
            low = middle
        else:
            high = middle - 1
    return low * step


def _between(spans: str, start: int, stop: int) -> dict[str, list[int]]:
    """Of each span that reaches into a part of its text, how much of it lies there, the most first."""
    found, at = defaultdict(list), 0
    for span in spans.split("-"):
        size = int(span[8:], 16)
        inside = min(at + size, stop) - max(at, start)
        if inside > 0:
            found[span].append(inside)
        at += size
    for sizes in found.values():
        sizes.sort(reverse=True)
    return found


def likeness(a: str, b: str) -> float:
    """The share of the longer text that lies in equal spans of both texts, wherever they stand.

    Counted are the longest common prefix and suffix among the sampled ones, and between them the spans that both
    texts have, each as often as both have it. 1 for equal fingerprints only; 0 between an empty text and another.
    """
    if a == b:
        return 1.0
    (n_a, _, pre_a, suf_a, spans_a), (n_b, _, pre_b, suf_b, spans_b) = a.split("."), b.split(".")
    n_a, n_b = int(n_a, 16), int(n_b, 16)
    steps = _step(n_a), _step(n_b)
    head, tail = _agreeing(pre_a, steps[0], pre_b, steps[1]), _agreeing(suf_a, steps[0], suf_b, steps[1])
    shared, longer = head + tail, max(n_a, n_b)
    if shared < min(n_a, n_b):
        inner_a, inner_b = _between(spans_a, head, n_a - tail), _between(spans_b, head, n_b - tail)
        for span in inner_a.keys() & inner_b.keys():
            shared += sum(map(min, inner_a[span], inner_b[span]))
    return min(shared, n_a, n_b, longer - 1) / longer


# --- documents and their edited texts ------------------------------------------------------

RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["key", *(part.split()[0] for part in RESULT.split(", "))]
    before = None  # the row whose next text is still to come
    for frame in frames:
        out = []
        for at, copy, name, body in zip(frame["__range"], frame["__copy"], frame["key"], frame["text"], strict=True):
            text = body or ""
            print_ = before[3] if before and before[2] == text else fingerprint(text)
            if before and before[0] == at:
                _, last, own, own_print = before
                edited = edited_text(own, text)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                edited_print = fingerprint(edited)
                near = likeness(own_print, edited_print), likeness(own_print, print_)
                out.append((last, len(own), digest, own_print, edited_print, *near))
            before = None if copy else (at, name, text, print_)
        yield pd.DataFrame(out, columns=names)


def _range_count(texts: DataFrame) -> int:
    """Ranges by the bytes of all texts."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_RANGES, max(RANGES_PER_PARTITION * partitions, -(-size // RANGE_BYTES)))


def _ranged(named: DataFrame, ranges: int) -> DataFrame:
    """``named`` with ``__range``, which grows with (``key``, ``mark``).

    Cuts are quantiles of the keys. A key that fills a range or more, or NULL, has ranges of its own, which its rows share
    by ``mark``. At most about three times ``ranges`` numbers come to the driver.
    """
    shares = [k / ranges for k in range(1, ranges)]
    cuts = named.agg(F.percentile_approx("key", shares, 10 * ranges)).first()[0] if shares else []
    hot = {r["key"]: -(-r["n"] * ranges // r["total"]) for r in heavy_hitters(named, "key", 1 / ranges).collect()}
    unkeyed = hot.pop(None, 1)
    # A hot key is alone in its range: the one that ends with it, behind a cut just below it.
    below = [k - 1 for k in hot if k > -(2**63)]
    bounds = np.unique(np.array([*(cuts or []), *below, *hot], np.int64))
    parts = np.ones(len(bounds) + 1, np.int64)
    for k, n in hot.items():
        parts[np.searchsorted(bounds, k)] = n
    starts = unkeyed + np.cumsum(parts) - parts

    @F.pandas_udf("long")
    def range_of(keys: pd.Series, unknown: pd.Series, marks: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.to_numpy(np.int64), side="left")
        null = unknown.to_numpy(bool)
        # The upper half of a mark, from 0 to 2^32, cut into equal parts.
        place = (marks.to_numpy(np.int64) >> 32) + (1 << 31)
        return pd.Series(np.where(null, 0, starts[at]) + (place * np.where(null, unkeyed, parts[at]) >> 32))

    return named.withColumn("__range", range_of(F.coalesce("key", F.lit(0)), F.col("key").isNull(), "mark"))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The next document is the next in order of the integer ``key`` (then of the text's XXH64, then of the text), the first
    one after the last; a single document is its own next one. NULL texts are empty, a NULL key comes first, and an empty
    table gives no rows. Other columns are ignored.

    Keys are cut into ranges of about equal numbers of rows, as many as the bytes of the texts ask for; a key that holds many rows is
    cut by the texts' hashes. The first row of each range is copied to the range before it, so the texts are shuffled
    once and each range is read on its own, row by row. Rows that agree in key and text are read by one task, and fingerprinted once.
    """
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    if ranges is None:
        ranges = _range_count(named)
    ranged = _ranged(named, ranges)
    # One row per range: its first key, which with NULL keys is NULL, and mark.
    least = ranged.select("__range", "key", "mark").groupBy("__range").agg(
        F.min(F.struct(F.col("key").isNotNull(), "key", "mark")).alias("least")
    )
    firsts = sorted((r["__range"], r["least"]["key"], r["least"]["mark"]) for r in least.collect())
    heads = [(at, k, mark, firsts[i - 1][0]) for i, (at, k, mark) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(heads, "at long, head long, head_mark long, to long")
    same = (F.col("mark") == F.col("head_mark")) & F.col("key").eqNullSafe(F.col("head"))
    found = named.join(F.broadcast(heads), same).groupBy("to", "key", "mark").agg(
        F.min(F.struct(F.col("text").isNotNull(), "text"))["text"].alias("text")
    )
    copies = found.select("key", "text", "mark", F.col("to").alias("__range"), F.lit(1).alias("__copy"))
    rows = ranged.withColumn("__copy", F.lit(0)).unionByName(copies)
    order = ["__range", "__copy", F.col("key").asc_nulls_first(), "mark", F.col("text").asc_nulls_first()]
    kind = docs.schema[key].dataType.simpleString()
    return (
        rows.repartition(max(1, len(firsts) // 2), "__range")
        .sortWithinPartitions(*order)
        .drop("mark")
        .withColumn("key", F.col("key").cast("string"))
        .mapInPandas(_rows, f"key string, {RESULT}")
        .select(F.col("key").cast(kind).alias(key), *(part.split()[0] for part in RESULT.split(", ")))
    )
