"""The corpus pipeline: stages over documents, each from its predecessor's rows.

Language ID drops documents of no language; exact dedup keeps one of equal
texts, SimHash near-dedup one of each group of near copies; substring dedup
removes passages that occur earlier; packing cuts and places what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.llm.common import saved, table
from catena.llm.exact_dedup import exact_dedup
from catena.llm.langid import UNDETERMINED, fit, identify, train_rows
from catena.llm.packing import pack_documents
from catena.llm.simhash import drop_near_duplicates
from catena.llm.substring_dedup import remove_passages


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and those without a letter go."""
    found = identify(docs, fit(docs, train_rows()), into=("_language", "_score"))
    return found.where(F.col("_language") != UNDETERMINED).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts, the one with the largest doc_id."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies (five words, similarity 0.8), the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words and more that occur earlier; n_chars follows, other texts stay as they are."""
    return remove_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Fingerprint groups, a trained model and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
