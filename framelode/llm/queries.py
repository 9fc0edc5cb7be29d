"""Queries of this subpackage: operator N over its whole table, as ``opN_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelode.llm import decontamination, lm_scoring, matroska, mixing, pii, secrets, sharding, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ce_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), labels.filter("quality = 1"))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op5_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(table(spark, sf_dir, "documents"))


def op9_url_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ce_difference": op1_ce_difference,
    "op2_pii_anchors": op2_pii_anchors,
    "op3_simhash_gray": op3_simhash_gray,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_secret_guess_cost": op5_secret_guess_cost,
    "op6_pivotal_mix": op6_pivotal_mix,
    "op7_toxicity_channel": op7_toxicity_channel,
    "op8_matroska_columns": op8_matroska_columns,
    "op9_url_ngram_filter": op9_url_ngram_filter,
    "op10_spaced_seeds": op10_spaced_seeds,
}

#: DuckDB SQL by query, where SQL can express the operator.
ORACLES: dict[str, str] = {}
