"""Documents in, a cleaned training corpus with token digests out: five stages, each one operator of pairscope.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of the documents. Empty
input passes through every stage; nulls, repeated rows and extra columns are treated as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairscope.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash
from pairscope.llm.store import as_table, documents


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    return byte_bpe.with_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("text")


STAGES = [
    ("quality classifier", accept),
    ("exact dedup", one_copy),
    ("simhash near-dedup", one_near_copy),
    ("benchmark decontamination", clean),
    ("byte-level BPE", encoded),
]
ORACLE_SQL = None  # a trained classifier has no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = as_table(docs, f"stage{k}")
    return docs
