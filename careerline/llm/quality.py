"""Quality classifier: nearest labelled documents in a latent semantic space vote."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerline.llm.textgrams import code_points, document_counts, gram_counts, inverse_frequencies

#: Labelled documents that are learned from, at most; taken in order of a hash of their keys.
LABELLED = 4000
DIMENSIONS = 64
NEIGHBOURS = 11
#: Scores from this on are predicted 1.
THRESHOLD = 0.7
SEED = 5
_TEXT_BITS, _SHAPE_BITS = 12, 11
#: Blocks of terms: letters, shapes, repetition. Each is scaled to its weight.
_BLOCKS = ((0, 1 << _TEXT_BITS, 0.5), (1 << _TEXT_BITS, (1 << _TEXT_BITS) + (1 << _SHAPE_BITS), 1.0))
_SAME, _OTHER = _BLOCKS[1][1], _BLOCKS[1][1] + 1
SIZE = _OTHER + 1
_BATCH = 256

# What a character looks like: classes for letters and digits, all else stands for itself.
_SHAPES = np.arange(1 << 16, dtype=np.uint32)
for _k in range(1 << 16):
    _c = chr(_k)
    _SHAPES[_k] = ord("A") if _c.isupper() else ord("a") if _c.isalpha() else ord("0") if _c.isdigit() else _k


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and counts of one text: letter triples, triples of character shapes, and words equal or not to
    the one before."""
    text = text or ""
    codes = code_points(text.lower())
    shapes = _SHAPES[np.minimum(code_points(text), (1 << 16) - 1)]
    words = text.split()
    same = sum(map(operator.eq, words, words[1:]))
    counts = np.concatenate(
        [gram_counts(codes, 3, _TEXT_BITS), gram_counts(shapes, 3, _SHAPE_BITS), [same, max(0, len(words) - 1 - same)]]
    )
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def weigh(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The term vector of a text: logarithmic counts by inverse document frequency, each block scaled to its weight.

    The repetition block holds the shares of repeated and other words.
    """
    vector = np.zeros(SIZE, np.float32)
    index, counts = found
    vector[index] = np.log1p(counts) * idf[index]
    for low, high, weight in _BLOCKS:
        length = np.linalg.norm(vector[low:high])
        if length:
            vector[low:high] *= weight / length
    repeated = dict(zip(index[index >= _SAME].tolist(), counts[index >= _SAME].tolist(), strict=True))
    pairs = sum(repeated.values())
    vector[_SAME] = repeated.get(_SAME, 0) / pairs if pairs else 0.0
    vector[_OTHER] = repeated.get(_OTHER, 0) / pairs if pairs else 0.0
    return vector


@dataclass(frozen=True)
class Voters:
    """The labelled documents as unit vectors of the latent space."""

    idf: np.ndarray
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # documents x dimensions
    labels: np.ndarray

    def scores(self, texts: list[str | None], neighbours: int) -> np.ndarray:
        """Exact cosines with all labelled documents; the labels of the nearest, weighted by their cosine."""
        prior = float(self.labels.mean()) if len(self.labels) else 1.0
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        latent = np.stack([weigh(terms(text), self.idf) for text in texts]) @ self.basis
        lengths = np.linalg.norm(latent, axis=1)
        known = lengths > 0
        cosines = (latent[known] / lengths[known, None]) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0).astype(np.float64)
        totals = weights.sum(axis=1)
        voted = (weights * self.labels[near]).sum(axis=1) / np.where(totals > 0, totals, 1.0)
        out[known] = np.where(totals > 0, np.clip(voted, 0.0, 1.0), prior)
        return out


class TermRows:
    """Term vectors of which only the terms that occur are held; products are taken over blocks of rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.rows = rows

    def blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.rows), _BATCH):
            part = self.rows[at : at + _BATCH]
            block = np.zeros((len(part), SIZE), np.float32)
            for vector, (index, weights) in zip(block, part, strict=True):
                vector[index] = weights
            yield block

    def times(self, basis: np.ndarray) -> np.ndarray:
        return np.concatenate([block @ basis for block in self.blocks()])

    def covariance_times(self, basis: np.ndarray) -> np.ndarray:
        """Rows' transpose by rows by ``basis``, in one pass over the rows."""
        total = np.zeros((SIZE, basis.shape[1]), np.float32)
        for block in self.blocks():
            total += block.T @ (block @ basis)
        return total


def _basis(rows: TermRows, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by randomised subspace iteration."""
    rng = np.random.default_rng(SEED)
    wide = min(len(rows.rows), SIZE, dimensions + 16)
    found = rng.standard_normal((SIZE, wide)).astype(np.float32)
    for _ in range(5):
        found, _ = np.linalg.qr(rows.covariance_times(found))
    _, _, right = np.linalg.svd(rows.times(found), full_matrices=False)
    return (found @ right.T)[:, :dimensions].astype(np.float32)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    labelled: int = LABELLED,
    dimensions: int = DIMENSIONS,
) -> Voters:
    """Fits the space on at most ``labelled`` rows of ``labels`` whose document is there.

    Document frequencies are counted over all of ``docs``. Only the labelled sample and one row per term reach
    the driver. Rows with NULL keys or labels are not learned from; a label of a repeated key counts once.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows, counts = document_counts(texts, terms, SIZE)
    idf = inverse_frequencies(rows, counts)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("label"))
    # The sample is a few thousand pairs of numbers by its parameter.
    chosen = known.join(texts.select("key").distinct(), "key", "left_semi")
    chosen = chosen.orderBy(F.xxhash64(F.lit(SEED), "key"), "key").limit(labelled)
    sample = texts.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("key", "label", "text")

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [weigh(terms(x), idf) for x in frame["text"]]
            seen = [np.flatnonzero(v) for v in vectors]
            yield pd.DataFrame(
                {
                    "key": frame["key"].astype(str),
                    "label": frame["label"],
                    "terms": [k.astype("<u2").tobytes() for k in seen],
                    "weights": [v[k].astype("<f2").tobytes() for v, k in zip(vectors, seen, strict=True)],
                }
            )

    found = sample.mapInPandas(measured, "key string, label double, terms binary, weights binary").collect()
    found = sorted((r["key"], r["label"], bytes(r["terms"]), bytes(r["weights"])) for r in found)
    if not found:
        return Voters(idf, np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    rows = TermRows([(np.frombuffer(t, "<u2"), np.frombuffer(w, "<f2")) for _, _, t, w in found])
    basis = _basis(rows, dimensions)
    latent = rows.times(basis)
    lengths = np.linalg.norm(latent, axis=1)
    kept = lengths > 0
    return Voters(idf, basis, latent[kept] / lengths[kept, None], np.array([r[1] for r in found])[kept])


def score(docs: DataFrame, voters: Voters, text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """Adds ``score`` from 0 to 1 to every row of ``docs``; whole texts count.

    Texts that have no term in common with the space (NULL and empty ones among them) get the share
    of label 1 in the labelled sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        parts = [shared.value.scores(texts.iloc[k : k + _BATCH].tolist(), neighbours) for k in range(0, len(texts), _BATCH)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", scores(F.col(text)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    held_out: int = 2,
    folds: int = 4,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    **options,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    A row is held out if the CRC-32 of its key as text leaves the remainder ``held_out``; its label is never learned.
    A NULL key is not held out and has no label. An empty table gives none.
    """
    fold = F.crc32(F.col(key).cast("string")) % folds
    voters = train(docs, labels.where(fold != held_out), key, text, **options)
    marked = score(docs, voters, text).withColumn("held_out", F.coalesce(fold == held_out, F.lit(False)))
    return marked.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
