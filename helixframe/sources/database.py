"""Graph databases: a Parquet dataset beside its k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


def save(dbg: DataFrame, path: str, k: int, buckets: int | None = None) -> None:
    """Write the graph hash-partitioned by key, so that later joins read balanced files."""
    spark = dbg.sparkSession
    rows = dbg.repartition(buckets, "key") if buckets else dbg
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/kmers")
    spark.createDataFrame([(k, VERSION)], "k int, version int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The graph and its k."""
    meta = spark.read.schema("k int, version int").json(f"{path}/meta").first()
    if meta is None:
        raise ValueError(f"{path} holds no graph")
    return spark.read.parquet(f"{path}/kmers"), meta["k"]


def load_same_k(spark: SparkSession, paths: list[str]) -> tuple[list[DataFrame], int]:
    found = [load(spark, p) for p in paths]
    if len({k for _, k in found}) != 1:
        raise ValueError("the graphs have different k")
    return [d for d, _ in found], found[0][1]
