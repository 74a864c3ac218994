"""A training-corpus pipeline: each stage is an operator on all documents that the stage before kept.

Every stage takes any table with the columns of ``documents``, further ones of any names included, and gives whole rows; the last
gives pieces. In all of them null texts are empty, null sources are one source, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import line_dedup, mixing, packing, quality_lines, simhash
from helixframe.llm.store import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects short, repetitive and depleted documents; the others lose their boilerplate lines.

    Empty texts are too short and go. Rows of equal identifier, text and source are judged alike, each its own row.
    """
    return quality_lines.clean_documents(docs)


def frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that ten documents or more share.

    Every row stays, even if no line is left. Rows of one identifier count as one document (null identifiers too).
    """
    return line_dedup.drop_frequent_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near copies, grouped as the SimHash query does.

    The one of the smallest identifier stays, then of the smallest text hash; null identifiers come last, and repeated rows are one.
    """
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or samples documents so that sources meet their token targets.

    A document stands up to two times. Null identifiers draw by their text; rows of equal key at the boundary go together.
    """
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of the mix into sequences.

    Every row is packed on its own, repeated ones too; an empty text is a piece of one id.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", frequent_lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mix),
    ("sequence_packing", sequence_packing),
]

#: SimHash components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
