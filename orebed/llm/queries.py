"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspolytope, elkan, lm_scoring, mixing, packed_ids, packing, quality_compression, quality_rules, simhash, spelling, suffix_dedup, toxicity, virtual_slots


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_compression.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scoring(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.packed_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(_table(spark, sf_dir, "documents"))


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.elkan_clusters(_table(spark, sf_dir, "embeddings"))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.placed(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that do not depend on the forest."""
    rows = quality_rules.judge(_table(spark, sf_dir, "documents"), None)
    return rows.select("doc_id", *quality_rules.COUNTS, "base_failed")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that do not depend on the filter."""
    rows = lm_scoring.base_scoring(_table(spark, sf_dir, "documents"))
    return rows.withColumn("base_score", F.round("base_score", 4))


QUERIES = {f.__name__: f for f in (rule_counts, lm_base, op1_quality_compression, op2_suffix_dedup, op3_lm_scoring, op4_toxicity, op5_crosspolytope, op6_packed_ids, op7_mixing, op8_quality_rules, op9_packing, op10_simhash, op11_elkan_clusters, op12_virtual_slots, op13_spelling_variants)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": suffix_dedup.SQL, "op5_crosspolytope": crosspolytope.SQL, "op7_mixing": mixing.SQL, "rule_counts": quality_rules.SQL, "lm_base": lm_scoring.SQL, "op11_elkan_clusters": elkan.SQL, "op12_virtual_slots": virtual_slots.SQL, "op13_spelling_variants": spelling.SQL}
