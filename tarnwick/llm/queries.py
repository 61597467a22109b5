"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import block_topk, hard_negatives, langid, licenses, mixing, packing, quality_model, quality_rules, sharding, simhash, toxicity, treaps, vptree


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=40)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _read(spark, sf_dir, "labels")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_read(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit_quality(docs, _read(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_languages(docs))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.exact_top_k(_read(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_packing, op3_sharding, op4_quality_rules, op5_mixing, op6_toxicity, op7_nearest, op8_licenses, op9_quality_model, op10_language, op11_exact_top_k, op12_ranked_search, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_licenses": licenses.scan_sql(), "op11_exact_top_k": block_topk.top_k_sql(),
        "op12_ranked_search": treaps.ranked_search_sql(), "op13_hard_negatives": hard_negatives.hard_negatives_sql(),
    }
