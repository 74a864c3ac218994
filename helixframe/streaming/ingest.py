"""Streaming ingest of reads into a graph: counts form a commutative monoid, so batches merge in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES
from helixframe.operators import packed
from helixframe.operators.windows import fragments, oriented_edges, windows
from helixframe.sources import database


def streaming_counts(reads: DataFrame, k: int = 21, sequence: str = "sequence") -> DataFrame:
    """Running k-mer counts of a streaming DataFrame, for complete or update output."""
    rows = oriented_edges(windows(fragments(reads, sequence), k))
    sums = [F.count("*").alias("cov")] + [F.count_if(F.col(c) == b).alias(f"{n}{i}") for n, c in (("fw", "f_base"), ("bw", "b_base")) for i, b in enumerate(BASES)]
    return rows.groupBy("key").agg(*sums)


class BatchMerger:
    """``foreachBatch`` sink: each batch becomes a delta of counted blocks named by its number, so a replayed batch
    overwrites its own delta and is not counted twice; ``compact`` sums the deltas into a database."""

    def __init__(self, spark: SparkSession, folder: str, k: int = 21, sequence: str = "sequence") -> None:
        self.spark, self.folder, self.k, self.sequence = spark, folder.rstrip("/"), k, sequence

    def __call__(self, batch: DataFrame, number: int) -> None:
        packed.partial(batch, self.k, self.sequence).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/delta/batch={number}")

    def graph(self) -> DataFrame:
        return packed.total(self.spark.read.schema(packed.BLOCKS).parquet(f"{self.folder}/delta"), self.k)

    def compact(self, path: str) -> None:
        database.save(self.graph(), path, self.k)


def ingest(reads: DataFrame, folder: str, k: int = 21, sequence: str = "sequence") -> DataFrame:
    """Drain a streaming DataFrame of reads and return the merged graph."""
    merger = BatchMerger(reads.sparkSession, folder, k, sequence)
    query = reads.writeStream.foreachBatch(merger).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return merger.graph()
