"""Assembly windows against the graph: tracks, missing k-mers, scores, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES, complement, error_rate, quality_value
from helixframe.operators.graph import BACKWARD, COUNTS, FORWARD
from helixframe.operators.windows import segments, windows

PLACE = ("path", "segment_id", "abs_start")
#: positions of a path that are joined or sorted together
BIN = 1 << 14


def _edge(columns: list[str], base: Column) -> Column:
    out = F.lit(0).cast("long")
    for c, b in zip(columns, BASES, strict=True):
        out = F.when(base == b, F.col(c)).otherwise(out)
    return out


def track(assembly: DataFrame, dbg: DataFrame, k: int = 21, *, path: str = "header", sequence: str = "sequence", whole: bool = False, intervals: DataFrame | None = None) -> DataFrame:
    """Per window: place, cov, right and left edge counts in sequence orientation, next and previous bases.

    ``assembly`` has records, or segments as ``segments`` makes them. One join on the key. Absent k-mers have cov 0. With ``whole`` every base has a row. ``intervals``
    (header, begin, end) keep only windows that start inside one.
    """
    parts = assembly if "abs_start" in assembly.columns else segments(assembly, path, sequence)
    rows = windows(parts, k, keep=PLACE, whole=whole)
    if intervals is not None:
        rows = in_intervals(rows.withColumn("abs_pos", F.col("abs_start") + F.col("pos")), intervals).drop("abs_pos")
    joined = rows.join(dbg.select("key", *COUNTS), "key", "left")
    joined = joined.withColumn("n_left", F.col("left")).withColumn("n_right", F.col("right"))
    right = F.when(F.col("is_fw"), _edge(FORWARD, F.col("n_right"))).otherwise(_edge(BACKWARD, complement(F.col("n_right"))))
    left = F.when(F.col("is_fw"), _edge(BACKWARD, F.col("n_left"))).otherwise(_edge(FORWARD, complement(F.col("n_left"))))
    return joined.select(
        "path",
        "segment_id",
        "pos",
        (F.col("abs_start") + F.col("pos")).alias("abs_pos"),
        "kcount",
        "key",
        "is_fw",
        F.coalesce("cov", F.lit(0)).alias("cov"),
        F.coalesce(right, F.lit(0)).alias("right"),
        F.coalesce(left, F.lit(0)).alias("left"),
    )


def position_bin(position: str) -> Column:
    return F.floor(F.col(position) / BIN)


def in_bins(intervals: DataFrame, begin: str, end: str) -> DataFrame:
    """Non-empty ``intervals`` once for every bin of positions that they touch; joins on path and bin spread a long path over many tasks."""
    full = intervals.where(F.col(end) > F.col(begin))
    return full.withColumn("bin", F.explode(F.sequence(F.floor(F.col(begin) / BIN), F.floor((F.col(end) - 1) / BIN))))


def in_intervals(rows: DataFrame, intervals: DataFrame, position: str = "abs_pos") -> DataFrame:
    """Rows whose position lies in an interval of their path: begin inclusive, end exclusive, from 0.

    Intervals are clipped to the last position of their path, so one that states a huge end has few bins.
    """
    last = rows.groupBy(F.col("path").alias("i_path")).agg((F.max(position) + 1).alias("i_last"))
    named = intervals.select(F.col("header").alias("i_path"), F.greatest("begin", F.lit(0)).alias("i_begin"), "end").join(last, "i_path")
    own = in_bins(named.select("i_path", "i_begin", F.least("end", "i_last").alias("i_end")), "i_begin", "i_end")
    near = (F.col("path") == F.col("i_path")) & (position_bin(position) == F.col("bin")) & (F.col(position) >= F.col("i_begin")) & (F.col(position) < F.col("i_end"))
    return rows.join(own, near, "left_semi")


def is_missing(cutoff: int = 0) -> Column:
    return (F.col("cov") == 0) | (F.col("cov") < cutoff)


def is_edge_missing(cutoff: int = 0) -> Column:
    """Present, yet the reads support neither the base before nor the base after it."""
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("kcount") - 1)
    return ~is_missing(cutoff) & inner & (F.col("left") == 0) & (F.col("right") == 0)


def totals(rows: DataFrame, cutoff: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    own = rows.where("pos < kcount")
    return own.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(is_missing(cutoff)).alias("missing"), F.count_if(is_edge_missing(cutoff)).alias("edge_missing"))


def scores(rows: DataFrame, k: int = 21, cutoff: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Two rows a group: k-mer based and edge based counts, QV and error."""
    found = totals(rows, cutoff, by)
    kinds = F.array(F.struct(F.lit("kmer").alias("method"), F.col("missing").alias("missing")), F.struct(F.lit("edge").alias("method"), (F.col("missing") + F.col("edge_missing")).alias("missing")))
    out = found.select(*by, "total", F.explode(kinds).alias("m")).select(*by, F.col("m.missing").alias("missing"), "total", F.col("m.method").alias("method"))
    error = error_rate(F.col("missing"), F.col("total"), k)
    return out.select(*by, "missing", "total", quality_value(error).alias("qv"), error.alias("error"), F.lit(k).alias("k"), "method")


def anomalies(rows: DataFrame, k: int = 21) -> DataFrame:
    """(path, segment_id, position): the first base after a window that is absent or whose next edge is."""
    found = rows.where((F.col("pos") < F.col("kcount")) & ((F.col("cov") == 0) | ((F.col("pos") < F.col("kcount") - 1) & (F.col("right") == 0))))
    return found.select("path", "segment_id", (F.col("abs_pos") + k).alias("position"))


def support_ahead(rows: DataFrame, k: int = 21) -> DataFrame:
    """Per window the k windows after it: one point for each present, one less for each absent.

    Positions are sorted in chunks, each with the k positions after it.
    """
    chunk = F.floor(F.col("pos") / BIN)
    homes = F.when((F.col("pos") % BIN < k) & (F.col("pos") >= BIN), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    spread = rows.where("pos < kcount").withColumn("chunk", F.explode(homes))
    ahead = Window.partitionBy("path", "segment_id", "chunk").orderBy("pos").rowsBetween(1, k)
    scored = spread.withColumn("score", F.coalesce(F.sum(F.when(F.col("cov") > 0, 1).otherwise(-1)).over(ahead), F.lit(0)))
    return scored.where(chunk == F.col("chunk")).drop("chunk")


def lookup_kmer(dbg: DataFrame, kmer: str) -> DataFrame:
    from helixframe.functions.bases import canonical

    return dbg.where(F.col("key") == canonical(F.lit(kmer.upper())))
