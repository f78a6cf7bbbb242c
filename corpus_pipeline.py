"""A training corpus from documents: each stage works on what the one before kept.

All stages take null ids, texts, languages and sources, empty and very long texts, ties and repeated rows, columns with
any other names, and no rows: then they return no rows. All but the last return the columns of their input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, packing, quality_model, quality_rules, simhash
from quillon.llm.common import bounded_batches, shared_folder, table
from quillon.llm.queries import TOKENIZER


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject: a score of at least 0.3. A null text is judged as an
    empty one; of repeated rows all stay or all go."""
    return quality_model.good_documents(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands that pass the base rules. Null and empty texts have no words and go; of
    repeated rows all stay or all go."""
    return quality_rules.quality_rules(docs, keep_columns=True)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of those that share five-word shingles at a similarity of 0.8 or more: that of the
    smallest doc_id, of repeated rows one. Null and empty texts are one class, a null doc_id comes last."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows each, all or none of those with one doc_id. A null source
    is one of its own; a source without words is left out."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, at least one of each row. A null text is empty; a long one has many pieces."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near duplicates", deduplicate), ("mixing", mix), ("packing", pack)]

#: SQL has neither zstandard nor XXH64 nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
