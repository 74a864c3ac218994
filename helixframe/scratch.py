"""Shared scratch tables: written results that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``. Where that is unset a temporary folder serves, if the master is local.

    On a cluster every machine would have its own temporary folder, so there the setting is required.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def materialise(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and return it reread."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, tag: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """Write ``df`` in the shared scratch folder in ``buckets`` buckets by ``keys``, each sorted, and return it as a table.

    Joins and aggregations on the keys of such tables need no shuffle. Rows that come hash-partitioned by the
    keys, as from a group or join on them, are written as one file a bucket.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    out = spark.table(name)
    out.scratch_path, out.scratch_name = path, name
    return out


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.pop(path, None)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that no open plan reads any more."""
    for table in tables:
        if name := getattr(table, "scratch_name", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        discard(table.sparkSession, table.scratch_path)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):
            discard(spark, path)
