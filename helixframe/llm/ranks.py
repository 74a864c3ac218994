"""Gapless ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OWN = ("__salt", "__own", "__g", "__s", "__n", "__base")


def spread_rank(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: ranks 0, 1, ... inside each ``group``, without one task a group.

    Rows of a group are dealt into salts by a hash of ``order``; salts are ranked on their own and
    start at the summed counts of the salts before. ``df`` is read twice, so it should be a
    written table, and without columns of names in ``_OWN``. Rows equal in ``order`` get neighbouring ranks in any order: ``order`` must
    tell apart all rows that differ, so that tasks run again deal the same ranks.
    """
    salts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(F.col(group).alias("__g"), F.col("__salt").alias("__s")).agg(F.count("*").alias("__n"))
    counts = counts.select("__g", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy(group, "__salt").orderBy(*order)
    ranked = salted.withColumn("__own", F.row_number().over(own) - 1)
    joined = ranked.join(counts, (F.col(group) == F.col("__g")) & (F.col("__salt") == F.col("__s")))
    return joined.withColumn(name, (F.col("__base") + F.col("__own")).cast("long")).drop("__salt", "__own", "__g", "__s", "__base")
