"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import licenses, line_dedup, media, mixing, ordinal, packing, quality_lines, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_table(spark, sf_dir, "documents"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.line_quality_report(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_license_scan": op3_license_scan,
    "op4_sequence_packing": op4_sequence_packing,
    "op5_line_quality": op5_line_quality,
    "op6_source_mixing": op6_source_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_pu_toxicity": op10_pu_toxicity,
}
ORACLES: dict[str, str] = {
    "op5_line_quality": quality_lines.QUALITY_SQL,
    "op6_source_mixing": mixing.MIX_SQL,
    "op7_line_dedup": line_dedup.LINES_SQL,
}
