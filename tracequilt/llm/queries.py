"""The registered query of every text operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracequilt.llm import (
    conversation_trie, license_scan, merkle, mixing, packing, prefix_hashes, quality, secret_scan, simhash, structure_sql, suffix_levels, suffix_search,
    token_files, url_filter,
)
from tracequilt.llm.common import documents

URL_RULES: list[url_filter.Rule] = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: Batches in which the table is taken to arrive.
BATCHES = 2


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, mixing.temperature_weights(docs), share=mixing.TOTAL_WEIGHT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(suffix_levels.hash_batches(documents(spark, sf_dir), BATCHES))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hashes.neighbour_fingerprints(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir), merkle.without_line_ends())


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_search.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_packing, op3_mixing, op4_suffix_dedup, op5_url_filter, op6_fingerprints, op7_token_files, op8_quality,
        op9_secrets, op10_simhash, op11_merkle_manifest, op12_conversation_trie, op13_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op3_mixing": mixing.oracle(),
    "op5_url_filter": url_filter.oracle(URL_RULES),
    "op8_quality": quality.oracle(),
    "op11_merkle_manifest": structure_sql.merkle(),
    "op12_conversation_trie": structure_sql.trie(),
    "op13_decontamination": structure_sql.decontamination(),
}
