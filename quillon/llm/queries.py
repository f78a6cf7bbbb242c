"""The corpus operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import centroids, html_text, licenses, maxscore, mixing, packing, prefix_trie, quality_model, quality_rules, simhash, token_counts, token_files, vector_forest
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality_scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_packing, op2_quality, op3_licenses, op4_token_files, op5_simhash, op6_token_counts, op7_quality_rules, op8_mixing, op9_top_k, op10_html_text, op11_clusters, op12_prefix_trie, op13_vector_duplicates, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The others need tokenizers, compression, hashes or parsing that SQL lacks; tests hold them against brute force."""
    return {"op3_licenses": licenses.oracle(), "op8_mixing": mixing.oracle(), "op9_top_k": maxscore.oracle(), "op11_clusters": centroids.oracle(), "op12_prefix_trie": prefix_trie.oracle(), "op13_vector_duplicates": vector_forest.oracle()}
