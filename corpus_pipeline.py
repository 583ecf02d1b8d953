"""From raw documents to token files: toxic documents go, near-duplicates are reduced to one, documents with benchmark passages go,
sources are mixed to their target weights, and what is left is written as token ids and read back.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``, the last one a row per document
written: doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gamspark.llm import decontaminate, mixing, neardup, tokens, toxicity
from gamspark.llm.common import stored, table
from gamspark.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, learned from the labels of these documents, gives 0.5 or more."""
    ship_package(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the least id."""
    ship_package(spark)
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark item was found."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    ship_package(spark)
    return tokens.token_output(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("token_output", write_tokens),
]

#: The tokenizer cannot be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
