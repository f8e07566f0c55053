"""From documents to training sequences: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferryline.llm._shared import materialize
from ferryline.llm.best_fit import pack
from ferryline.llm.exact_dedup import drop_copies
from ferryline.llm.language_id import drop_unidentified
from ferryline.llm.ngram_jaccard import drop_near_copies
from ferryline.llm.substring_dedup import remove_repeats
from ferryline.llm.tokens import WORD_BPE, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identified language."""
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 5-word shingles at 0.8 or more."""
    return drop_near_copies(docs, n=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that stand in an earlier document."""
    return remove_repeats(docs, width=50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path(WORD_BPE), size=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]

#: Naive Bayes and bin packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again; the pieces and their places in the sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
