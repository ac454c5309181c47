"""From raw documents to packed training sequences: five stages, each on all rows the one before has kept.

Every stage takes and returns the columns of ``documents``, except the last,
which returns where each piece of each document's ids lies in the packed
sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracequilt.llm import mixing, near_copies, packing, quality, secret_scan
from tracequilt.llm.common import documents
from tracequilt.runtime import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules, and failing lines from the others."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: similarity of at least 0.8 on five-word shingles."""
    return near_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces secrets in their texts."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, in the order of the mixture: part files in order, rows in order inside."""
    return mixing.mixed(docs, mixing.temperature_weights(docs), share=mixing.TOTAL_WEIGHT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in the packed sequences, which follow the mixture file by file."""
    return packing.pack_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither SimHash components nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
