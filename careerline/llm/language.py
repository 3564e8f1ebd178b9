"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careerline.llm.textgrams import code_points, document_counts, gram_counts, inverse_frequencies

#: Documents per language that are learned from, at most; taken in order of a hash of their keys.
PER_LANGUAGE = 800
EPOCHS = 3
#: Step size and smoothing of the steps, and the weights of the penalties.
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.02
#: One in so many of the learned documents sets the temperature instead of the weights.
CALIBRATION = 5
UNDETERMINED = "und"
SEED = 3
_BITS = 12
_GRAMS = (1, 2, 3)
SIZE = len(_GRAMS) << _BITS
_LETTER = re.compile(r"[^\W\d_]")  # and a few numerals, such as raised digits


def has_letter(text: str | None) -> bool:
    return any(found[0].isalpha() for found in _LETTER.finditer(text or ""))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the single characters, pairs and triples of the lower-cased text."""
    codes = code_points((text or "").lower())
    counts = np.concatenate([gram_counts(codes, n, _BITS) for n in _GRAMS])
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def weigh(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of a text, of length 1, as term numbers and values."""
    index, counts = found
    values = np.log1p(counts) * idf[index]
    length = np.linalg.norm(values)
    return index, values / length if length else values


def _softmax(margins: np.ndarray) -> np.ndarray:
    powers = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader: per-coordinate steps, with an absolute and a squared penalty."""

    def __init__(self, size: int, classes: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.sums = np.zeros((size, classes))
        self.squares = np.zeros((size, classes))

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        """Weights whose gradient sums stay within the absolute penalty are zero."""
        sums, squares = self.sums[index], self.squares[index]
        rate = (self.beta + np.sqrt(squares)) / self.alpha + self.l2
        return np.where(np.abs(sums) <= self.l1, 0.0, (np.sign(sums) * self.l1 - sums) / rate)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(index)
        wrong = _softmax(values @ weights)
        wrong[label] -= 1.0
        gradient = values[:, None] * wrong
        squares = self.squares[index]
        added = squares + gradient * gradient
        self.sums[index] += gradient - (np.sqrt(added) - np.sqrt(squares)) / self.alpha * weights
        self.squares[index] = added


def temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the margins that makes the labels likeliest, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        chances = _softmax(margins / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(chances, 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Identifier:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # terms x languages
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            if not self.languages or not has_letter(text):
                names.append(UNDETERMINED)
                continue
            index, values = weigh(terms(text), self.idf)
            chances = _softmax(values @ self.weights[index] / self.temperature)
            best = int(chances.argmax())
            names.append(self.languages[best])
            scores[k] = chances[best]
        return names, scores


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    epochs: int = EPOCHS,
    l1: float = L1,
    l2: float = L2,
) -> Identifier:
    """Fits weights on at most ``per_language`` documents of each language.

    Document frequencies are counted over all of ``docs`` that have a language. Rows without language, and
    texts without a letter, are not learned from. The sample, one row per term and one per language
    reach the driver.
    """
    known = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where("lang IS NOT NULL")
    rows, counts = document_counts(known, terms, SIZE)
    idf = inverse_frequencies(rows, counts)
    # A share of the hashes leaves about three times the rows that are wanted of each language, so no task
    # sorts a whole language; there is one row per language to join.
    lettered = known.where(F.col("text").rlike(r"\p{L}"))
    frequent = known.groupBy("lang").agg(F.count("*").alias("n"))
    hashed = lettered.select("key", "lang", F.xxhash64(F.lit(SEED), "key").alias("place"))
    share = F.shiftrightunsigned("place", 1) / F.lit(float(1 << 63))
    few = hashed.join(F.broadcast(frequent), "lang").where(share * F.col("n") <= 3 * per_language)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("place", "key"))
    chosen = few.withColumn("at", place).where(F.col("at") <= per_language).select("key", "lang").distinct()
    # Rows that repeat a key count once; the first by the text's hash stands for them.
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    sample = lettered.join(F.broadcast(chosen), ["key", "lang"]).groupBy("key", "lang").agg(one)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [weigh(terms(x), idf) for x in frame["text"]]
            yield pd.DataFrame(
                {
                    "key": frame["key"],
                    "lang": frame["lang"],
                    "terms": [index.astype("<u2").tobytes() for index, _ in found],
                    "weights": [values.astype("<f4").tobytes() for _, values in found],
                }
            )

    schema = "key string, lang string, terms binary, weights binary"
    found = sample.mapInPandas(measured, schema).collect()
    found = sorted((r["key"] or "", r["lang"], bytes(r["terms"]), bytes(r["weights"])) for r in found)
    languages = sorted({r[1] for r in found})
    model = Ftrl(SIZE, max(1, len(languages)), ALPHA, BETA, l1, l2)
    data = [
        (np.frombuffer(t, "<u2").astype(np.int64), np.frombuffer(w, "<f4").astype(np.float64), languages.index(name))
        for _, name, t, w in found
    ]
    order = np.random.default_rng(SEED).permutation(len(data))
    apart = [data[k] for k in order[::CALIBRATION]] if len(data) >= 10 * CALIBRATION else []
    fitted = [data[k] for n, k in enumerate(order) if n % CALIBRATION] if apart else data
    for _ in range(epochs):
        for index, values, label in fitted:
            model.learn(index, values, label)
    weights = model.weights(slice(None))
    margins = np.array([values @ weights[index] for index, values, _ in apart])
    heat = temperature(margins, np.array([label for *_, label in apart], np.int64))
    return Identifier(languages, idf, weights, heat)


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the calibrated chance of that language; whole texts count.

    NULL texts and texts without a letter are ``und`` with score 0, as are all texts if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})

    marked = docs.withColumn("__found", found(F.col(text)))
    return marked.withColumn("lang_pred", F.col("__found.lang")).withColumn("score", F.col("__found.score")).drop("__found")


def classify(
    docs: DataFrame, held_out: int = 1, folds: int = 3, key: str = "doc_id", text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` of every document.

    A row is held out if the CRC-32 of its key as text leaves the remainder ``held_out``; nothing of it is learned, nor of
    rows with a NULL key, which are not held out. An empty table gives none.
    """
    fold = F.crc32(F.col(key).cast("string")) % folds
    model = train(docs.where(fold != held_out), key, text, lang, **options)
    marked = identify(docs.select(key, text), model, text)
    return marked.select(key, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
