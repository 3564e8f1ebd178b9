"""Main text of HTML pages: text blocks classified by a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerline.llm.html_blocks import FEATURES, page_blocks

# The labelled table. Each line is a block: its words and link density, those of the
# block before and the block after, its place (2 in the article, 1 on a page whose words are mostly outside of any, 0 outside the article), whether it
# stands aside, and the label (1 main text).
LABELLED = """
6 1.00 0 0.00 6 1.00 0 1 0
1 1.00 1 1.00 1 1.00 0 1 0
3 1.00 2 1.00 12 0.00 0 1 0
14 0.00 2 1.00 9 0.00 0 1 0
9 0.00 80 0.00 0 0.00 0 1 0
25 0.00 80 0.00 40 0.00 0 1 0
140 0.00 30 0.00 60 0.00 0 1 0
18 0.30 60 0.00 20 0.20 0 1 0
12 0.00 0 0.00 8 0.00 0 0 0
30 0.10 6 1.00 50 0.00 0 0 0
90 0.00 4 1.00 20 0.00 0 0 0
2 1.00 60 0.00 0 0.00 0 0 0
5 0.00 200 0.00 3 1.00 0 0 0
9 0.00 14 0.00 80 0.00 2 0 1
1 0.00 9 0.00 1 0.00 2 0 1
2 0.00 0 0.00 3 0.00 2 0 1
4 0.00 12 0.00 0 0.00 2 0 1
80 0.00 9 0.00 60 0.00 2 0 1
250 0.00 80 0.00 9 0.00 2 0 1
60 0.08 250 0.00 14 0.00 2 0 1
35 0.25 60 0.00 40 0.00 2 0 1
22 0.45 35 0.10 18 0.00 2 0 1
3 0.00 1 1.00 200 0.00 2 0 1
700 0.01 5 0.00 5 0.00 2 0 1
12 0.00 6 1.00 5 0.00 2 0 1
2 1.00 60 0.00 3 1.00 2 0 0
4 1.00 2 1.00 30 0.00 2 0 0
7 0.95 30 0.00 20 0.00 2 0 0
1 1.00 80 0.00 9 0.00 2 0 0
12 0.90 4 1.00 40 0.00 2 0 0
15 0.00 60 0.00 40 0.00 2 1 0
120 0.00 60 0.00 40 0.00 2 1 0
4 0.00 60 0.00 9 0.00 2 1 0
3 1.00 60 0.00 3 1.00 2 1 0
40 0.10 6 0.00 40 0.00 2 1 0
50 0.00 8 0.00 60 0.00 1 0 1
120 0.02 50 0.00 40 0.00 1 0 1
30 0.00 120 0.00 45 0.00 1 0 1
18 0.10 40 0.00 60 0.00 1 0 1
8 0.00 0 0.00 70 0.00 1 0 1
6 0.00 90 0.00 55 0.00 1 0 1
25 0.00 0 0.00 0 0.00 1 0 1
11 0.00 30 0.00 28 0.00 1 0 1
48 0.00 48 0.00 1 1.00 1 0 1
60 0.05 1 1.00 60 0.00 1 0 1
35 0.00 2 1.00 1 1.00 1 0 1
4 0.00 3 1.00 2 1.00 1 0 0
3 1.00 4 1.00 5 1.00 1 0 0
8 0.80 3 1.00 9 0.90 1 0 0
20 0.70 8 0.80 30 0.60 1 0 0
40 0.65 20 0.70 6 1.00 1 0 0
2 0.00 8 0.90 4 1.00 1 0 0
5 0.00 6 1.00 6 1.00 1 0 0
15 0.00 60 0.00 0 0.00 1 1 0
90 0.00 8 0.00 40 0.00 1 1 0
5 1.00 5 1.00 5 1.00 1 1 0
3 0.00 0 0.00 30 0.00 1 1 0
60 0.00 70 0.00 80 0.00 0 0 1
120 0.02 50 0.00 90 0.00 0 0 1
45 0.00 120 0.00 60 0.00 0 0 1
35 0.05 60 0.00 45 0.00 0 0 1
200 0.00 8 0.00 150 0.00 0 0 1
180 0.00 150 0.00 6 0.00 0 0 1
70 0.90 60 0.00 80 0.00 0 0 0
45 0.80 90 0.10 60 0.00 0 0 0
150 0.00 120 0.00 140 0.00 0 1 1
90 0.00 100 0.00 110 0.00 0 1 1
200 0.02 90 0.00 160 0.00 2 1 1
110 0.00 150 0.00 90 0.00 1 1 1
80 0.05 130 0.00 120 0.00 2 1 1
300 0.00 200 0.00 180 0.00 0 1 1
150 0.90 120 0.00 140 0.00 0 1 0
90 0.85 100 0.10 110 0.20 1 1 0
"""
MAX_DEPTH = 6


def labelled_blocks(spark: SparkSession, table: str = LABELLED) -> DataFrame:
    rows = [[float(x) for x in line.split()] for line in table.strip().splitlines()]
    data = [(row[:-1], row[-1]) for row in rows]
    return spark.createDataFrame(data, "features array<double>, label double")


def block_tree(labelled: DataFrame, max_depth: int = MAX_DEPTH) -> DecisionTreeClassificationModel:
    """The tree trained on a small table of ``features`` and ``label``."""
    vectors = labelled.select(array_to_vector("features").alias("features"), "label").coalesce(1)
    return DecisionTreeClassifier(maxDepth=max_depth, maxBins=64, seed=1).fit(vectors)


def tree_condition(model: DecisionTreeClassificationModel, features: Column) -> Column:
    """The tree as one condition on an array of features, so that blocks are judged in the JVM."""
    lines = [line.strip() for line in model.toDebugString.splitlines()[1:]]
    steps = iter([line for line in lines if line])

    def node() -> Column:
        line = next(steps)
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]) == 1.0)
        at, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        next(steps)  # the Else line has the same bound
        return F.when(F.get(features, F.lit(int(at))) <= float(bound), low).otherwise(node())

    return node()


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars``: the main blocks of each page in page order, one to a line.

    The whole html is read. Pages without html or without a main block have an empty text. Broken html is
    read as far as its tags tell: an element that is never closed holds the rest of the page. Repeated rows
    and NULL keys are kept; other columns are left out.
    """

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [page_blocks(source) for source in frame["__html"]]
            yield pd.DataFrame(
                {"__key": frame["__key"], "__url": frame["__url"], "texts": [x[0] for x in found], "features": [x[1] for x in found]}
            )

    model = block_tree(labelled_blocks(pages.sparkSession) if labelled is None else labelled)
    kind = pages.schema[key].dataType.simpleString()
    named = pages.select(F.col(key).cast("string").alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html"))
    schema = "__key string, __url string, texts array<string>, features array<array<double>>"
    measured = named.mapInPandas(blocks, schema)
    is_main = lambda text, k: tree_condition(model, F.get("features", k))
    text = F.array_join(F.filter("texts", is_main), "\n")
    return measured.select(
        F.col("__key").cast(kind).alias(key), F.col("__url").alias(url), text.alias("text")
    ).withColumn("n_chars", F.char_length("text").cast("long"))
