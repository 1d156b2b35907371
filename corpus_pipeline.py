"""A training corpus from ``documents``: identified, without exact and near copies and repeated passages, packed.

Every stage takes texts of any length, gives an empty table for an empty one and passes columns beside those it
reads through unchanged; ties go as each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import exact_dedup, langid, ngram_join, packing, span_dedup
from lagwise.plans.scratch import materialize
from lagwise.plans.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is in doubt, go; so do null and empty texts. Repeated rows stay or go together."""
    ship(spark)
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, of rows that repeat it one; rows without an id go before none. Null counts as empty."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at 0.8 or more over five-word shingles, the smallest doc_id stays. Rows without words or an id stay."""
    ship(spark)
    return ngram_join.drop_near_copies(docs, width=5, threshold="0.8")


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go from the text; a document that loses all of its text goes too. Null texts and ids stay as they are."""
    ship(spark)
    cut = span_dedup.drop_repeated_spans(docs)
    empty = (F.size("removed") > 0) & (F.trim(F.col("text")) == "")
    return cut.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences; null and empty texts give one piece."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("repeated_spans", repeated_spans), ("best_fit_packing", best_fit_packing)]

#: SQL has neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
