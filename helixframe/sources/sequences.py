"""Sequence, graph and interval files as DataFrames. Files may be gzipped; several paths may be given."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import reverse_complement

RECORD = ["header", "comment", "sequence", "quality", "seq_pos"]


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def sniff(spark: SparkSession, path: str) -> str:
    """fasta, fastq or gfa by the first character."""
    first = spark.read.text(path).where(F.length("value") > 0).head(1)
    return {">": "fasta", "@": "fastq"}.get(first[0][0][0] if first else ">", "gfa")


def _named(rows: DataFrame) -> DataFrame:
    """Header up to the first blank; the rest is the comment, null where there is none."""
    head = F.regexp_extract("title", r"^(\S*)", 1)
    comment = F.regexp_extract("title", r"^\S*\s+(.*)$", 1)
    return rows.select(head.alias("header"), F.when(comment != "", comment).alias("comment"), "sequence", "quality", F.monotonically_increasing_id().alias("seq_pos"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records start at a line-initial '>'; the body may span lines. ``seq_pos`` rises in file order."""
    rows = spark.read.text(_paths(path), lineSep="\n>")
    whole = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    rows = rows.select(whole.alias("v")).where(F.length(F.trim("v")) > 0)
    body = F.regexp_replace(F.regexp_replace("v", "^[^\n]*", ""), r"\s+", "")
    return _named(rows.select(F.substring_index("v", "\n", 1).alias("title"), body.alias("sequence"), F.lit(None).cast("string").alias("quality")))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Four-line records. A quality line that starts with '@' cannot be told from a header by a splitter:
    it becomes a piece without a '+' line, which is dropped, and its record's quality is null."""
    rows = spark.read.text(_paths(path), lineSep="\n@")
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\r", ""), "\n")
    rows = rows.select(lines.alias("l")).where((F.size("l") >= 3) & F.get("l", F.lit(2)).startswith("+"))
    quality = F.get("l", F.lit(3))
    return _named(rows.select(F.get("l", F.lit(0)).alias("title"), F.get("l", F.lit(1)).alias("sequence"), F.when(quality != "", quality).alias("quality")))


def read_gfa(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(S: name, sequence) and (path, comp_idx, name, orientation) of a GFA 1 or GFA 2 file.

    GFA 2 segments state their length before the sequence, and its paths are O lines of blank-separated steps.
    """
    rows = spark.read.text(_paths(path)).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    kind, one, two, three = (F.get("f", F.lit(i)) for i in range(4))
    sized = two.rlike("^[0-9]+$") & three.isNotNull() & ~F.coalesce(three, F.lit("")).rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")
    nodes = rows.where(kind == "S").select(one.alias("name"), F.when(sized, three).otherwise(two).alias("sequence"))
    steps = rows.where(kind.isin("P", "O")).select(one.alias("path"), F.posexplode(F.split(two, F.when(kind == "P", "[,;]").otherwise(" +"))).alias("comp_idx", "step"))
    return nodes, steps.select("path", "comp_idx", F.regexp_replace("step", "[+-]$", "").alias("name"), F.right("step", F.lit(1)).alias("orientation"))


def gfa_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Steps of the paths as segments (path, segment_id, abs_start, seq, raw, length)."""
    nodes, steps = read_gfa(spark, path)
    rows = steps.join(nodes, "name").withColumn("raw", F.when(F.col("orientation") == "-", reverse_complement(F.upper("sequence"))).otherwise(F.col("sequence")))
    before = Window.partitionBy("path").orderBy("comp_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("long")
    return rows.select("path", F.col("comp_idx").cast("long").alias("segment_id"), start.alias("abs_start"), F.upper("raw").alias("seq"), "raw", F.length("raw").cast("long").alias("length"))


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads or an assembly from FASTA or FASTQ files, each kind found by its first character."""
    out = None
    for p in _paths(path):
        kind = sniff(spark, p)
        if kind == "gfa":
            raise ValueError(f"{p} is no FASTA or FASTQ file")
        rows = read_fasta(spark, p) if kind == "fasta" else read_fastq(spark, p)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_assembly(spark: SparkSession, path: str) -> DataFrame:
    """Records of a FASTA or FASTQ file, or the segments of a GFA file's paths."""
    return gfa_segments(spark, path) if sniff(spark, path) == "gfa" else read_sequences(spark, path)


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, begin, end) from blank-separated lines; others are ignored."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(_paths(path)).select(f.alias("f")).where((F.size("f") >= 3) & F.get("f", F.lit(1)).rlike("^[0-9]+$") & F.get("f", F.lit(2)).rlike("^[0-9]+$"))
    return rows.select(F.get("f", F.lit(0)).alias("header"), F.get("f", F.lit(1)).cast("long").alias("begin"), F.get("f", F.lit(2)).cast("long").alias("end"))


def parse_coordinate(spark: SparkSession, text: str) -> DataFrame:
    """``header`` or ``header:begin-end`` as one interval; a bare header spans the whole path."""
    m = re.fullmatch(r"(.+?)(?::(\d+)-(\d+))?", text)
    begin, end = (int(m[2]), int(m[3])) if m[2] else (1, 1 << 60)
    return spark.createDataFrame([(m[1], begin, end)], "header string, begin long, end long")
