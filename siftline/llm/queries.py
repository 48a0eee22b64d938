"""Queries of the pipeline's operators over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import mixing, packing, perplexity_rules, rule_ensemble, simhash, suffix, topk, toxicity, warc, word_lm


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_t(spark, sf_dir, "embeddings")).withColumn("score", F.round("score", 6))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_t(spark, sf_dir, "documents"))


def op4_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.passages(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op5_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules.kept(_t(spark, sf_dir, "documents"))


def op6_lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lm.perplexity(_t(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(_t(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.dedup_pages(_t(spark, sf_dir, "pages"))


def op9_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.qualities(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op10_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nnls_packing,
        op2_threshold_topk,
        op3_poisson_mixing,
        op4_toxic_passages,
        op5_perplexity_bands,
        op6_lm_perplexity,
        op7_repeated_passages,
        op8_warc_revisits,
        op9_rule_quality,
        op10_simhash_near_dups,
    )
}

#: DuckDB SQL of the operators that SQL can express; the others are tested against brute force.
SQL = {"op2_threshold_topk": topk.SQL, "op3_poisson_mixing": mixing.SQL, "op8_warc_revisits": warc.SQL}
