"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowwatch.llm import (ann_forest, cover_tree, licenses, linededup, merkle, mixing, prefix_trie, quality, sentencepieces, sharding, simhash,
                           token_store, toxicity)
from flowwatch.llm.common import table, vocabulary


def op1_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hash_forest, op2_sharding, op3_cover_tree, op4_token_store, op5_simhash, op6_line_dedup, op7_toxicity, op8_sentencepiece, op9_licenses, op10_mixing,
                                   op11_quality_rules, op12_merkle, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_cover_tree": cover_tree.ORACLE_SQL, "op6_line_dedup": linededup.ORACLE_SQL, "op9_licenses": licenses.oracle_sql(), "op10_mixing": mixing.ORACLE_SQL,
            "op11_quality_rules": quality.oracle_sql(), "op12_merkle": merkle.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
