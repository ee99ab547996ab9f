"""The corpus pipeline: five operators of the subpackage, one after the other.

Each stage takes the documents that the stage before kept, as a table, and all
but the last return the columns of ``documents``.

Defined results: null and empty texts fail the base rules and go in the first
stage; rows without an id, and rows that share one, are documents of their own
in every stage, and only a copy of a kept text makes one of them go; rows
without an id lose no passage to others; further columns are kept as they are,
whatever they are called, but for ``n_chars``, which follows the text; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orebed.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from orebed.operators.stored import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest let pass; the forest learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_documents(docs, quality_rules.fit(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id."""
    return simhash.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in a document of smaller id."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash", keep_one_of_each),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The forest's splits, SimHash's hashes and the packing's search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
