"""Hashed character n-grams of whole texts, and their corpus counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points that are worked on at once, so that a long text takes bounded memory.
_CHUNK = 1 << 20
_MULTIPLIER = np.uint32(2_654_435_761)
_MIXER = np.uint32(2_246_822_519)

#: Term numbers and their counts in one text.
Terms = tuple[np.ndarray, np.ndarray]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_counts(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Counts of the n-grams of a text by hash, as an array of ``2**bits``."""
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, max(0, len(codes) - n + 1), _CHUNK):
        part = codes[at : at + _CHUNK + n - 1]
        size = len(part) - n + 1
        hashed = np.full(size, n, np.uint32)
        for k in range(n):
            hashed = (hashed + part[k : k + size]) * _MULTIPLIER
            hashed ^= hashed >> np.uint32(15)
        hashed *= _MIXER
        counts += np.bincount(hashed >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


def document_counts(texts: DataFrame, terms: Callable[[str | None], Terms], size: int) -> tuple[int, np.ndarray]:
    """The number of rows, and per term the number of rows that have it. All rows of column ``text`` count.

    Each task sends one row per term; ``size`` rows reach the driver at most.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = np.zeros(size, np.int64), 0
        for frame in frames:
            rows += len(frame)
            for text in frame["text"]:
                found[terms(text)[0]] += 1
        seen = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.append(seen, -1), "n": np.append(found[seen], rows)})

    summed = texts.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts, rows = np.zeros(size, np.int64), 0
    for row in summed.collect():
        if row["term"] < 0:
            rows = row["n"]
        else:
            counts[row["term"]] = row["n"]
    return rows, counts


def inverse_frequencies(rows: int, counts: np.ndarray) -> np.ndarray:
    return np.log((1.0 + rows) / (1.0 + counts)) + 1.0
