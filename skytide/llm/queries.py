"""Queries p8 to p10 over the documents, and their SQL where SQL can say it (it can't)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytide.llm.abuse import THRESHOLD, scores, source_rates
from skytide.llm.leakage import leaks
from skytide.llm.tokenizer import encode
from skytide.sources.tables import table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("SKYTIDE_TOKENIZERS", "/opt/tokenizers")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return encode(rows, F.col("doc_id"), F.col("text"), f"{TOKENIZERS}/byte_bpe_50k.json").withColumnRenamed("key", "doc_id")


def p9_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "item_text")
    found = leaks(rows, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("item_text"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "tiles", "longest", (F.col("covered") / F.col("item_words")).alias("coverage"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_tiles(spark, d).select("doc_id", "item_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, samples = table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "review_samples", "sample_id", "sample_text", "verdict")
    return scores(rows, F.col("doc_id"), F.col("text"), samples, keep={"source": F.col("source")}).withColumnRenamed("key", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(p10_scores(spark, d), "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_tiles": p9_tiles,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

SQL: dict[str, str] = {}
