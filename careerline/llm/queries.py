"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerline.llm import (
    chat_format, conversation_repair, fill_in_middle, fingerprints, html_text, language, line_dedup, mixing, neighbours, packing, quality,
    simhash, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate of its source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs)


def vocabulary() -> str:
    """The tokenizer whose ids the packed sequences hold."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-hash fingerprints of every document and its edited text."""
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules of the query: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages, URL_RULES).drop("url")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.classify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every damaged conversation, its cheapest repair and the hash of the repaired rows."""
    return conversation_repair.digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: A conversation whose texts look like the template.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from the training examples of every conversation, and of one with control strings."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise(chat_format.ASSISTANT).alias("role")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.digests(chat_format.examples(given.unionByName(added)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form and cuts of every document, and the hashes of its output and of the text made from it again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.fill_in_middle(docs)
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_repair": op11_repair,
    "op12_chat_format": op12_chat_format,
    "op13_fill_in_middle": op13_fill_in_middle,
}
