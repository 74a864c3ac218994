"""Windowed tracks, range lookups and text forms of a per-base track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.evaluate import in_bins, position_bin

SERIES = ("cov", "right", "left")
#: positions that are sorted together
CHUNK = 1 << 14
SEPARATORS = {"bed": ("\t", ":"), "csvtable": (",", ","), "csv": (",", " ")}


def covering(rows: DataFrame, k: int = 21) -> DataFrame:
    """Per base the values of the k windows that cover it, oldest first, zeros where none starts.

    Positions fall into chunks that are sorted on their own, so a long segment is many tasks; a chunk also gets
    the k - 1 positions before it.
    """
    chunk, span = F.floor(F.col("pos") / CHUNK), F.lit(CHUNK)
    homes = F.when(F.col("pos") % span >= span - (k - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = rows.select("path", "segment_id", "pos", "abs_pos", *SERIES, F.explode(homes).alias("chunk"))
    frame = Window.partitionBy("path", "segment_id", "chunk").orderBy("pos").rowsBetween(-(k - 1), 0)
    item = F.collect_list(F.struct(*SERIES)).over(frame)

    def padded(name: str) -> Column:
        own = F.transform("covering", lambda x: x[name])
        return F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size(own)), own)

    held = spread.withColumn("covering", item).where(chunk == F.col("chunk"))
    return held.select("path", "segment_id", "pos", "abs_pos", *[padded(c).alias(f"{c}_k") for c in SERIES])


def lookup(rows: DataFrame, intervals: DataFrame, span: int = 0) -> DataFrame:
    """Track rows in each interval (header, begin, end), which counts from 1 and is half open.

    The range is widened by ``span``, starts at 0 at least and is clipped to the segment that holds
    its start; an interval that starts outside any segment has no rows. Segments are few a path,
    so their bounds meet the intervals first and the track joins on its own segment.
    """
    bounds = rows.groupBy("path", "segment_id").agg(F.min("abs_pos").alias("lo"), (F.max("abs_pos") + 1).alias("hi"))
    wanted = intervals.select(
        F.col("header").alias("w_path"),
        "begin",
        "end",
        F.greatest(F.col("begin") - span - 1, F.lit(0)).alias("first"),
        (F.col("end") + span - 1).alias("stop"),
    )
    clipped = wanted.join(bounds, (F.col("w_path") == F.col("path")) & (F.col("first") >= F.col("lo")) & (F.col("first") < F.col("hi")))
    clipped = clipped.select("w_path", F.col("segment_id").alias("w_segment"), "begin", "end", "first", F.least("stop", "hi").alias("stop"))
    clipped = in_bins(clipped, "first", "stop")
    inside = (F.col("path") == F.col("w_path")) & (F.col("segment_id") == F.col("w_segment")) & (position_bin("abs_pos") == F.col("bin"))
    inside = inside & (F.col("abs_pos") >= F.col("first")) & (F.col("abs_pos") < F.col("stop"))
    return rows.join(clipped, inside).select("path", "begin", "end", "first", "stop", "abs_pos", *[c for c in rows.columns if c in (*SERIES, *(f"{s}_k" for s in SERIES))])


def project_intervals(components: DataFrame, intervals: DataFrame) -> DataFrame:
    """Intervals on paths cut at segments: (path, comp_idx, begin, end) from the segment's start."""
    own = components.where("kind = 'SEGMENT'")
    near = (F.col("header") == F.col("path")) & (F.col("begin") < F.col("abs_start") + F.col("length")) & (F.col("end") > F.col("abs_start"))
    cut = intervals.join(own, near)
    return cut.select("path", "comp_idx", (F.greatest("begin", "abs_start") - F.col("abs_start")).alias("begin"), (F.least(F.col("end"), F.col("abs_start") + F.col("length")) - F.col("abs_start")).alias("end"))


def expand_intervals(intervals: DataFrame) -> DataFrame:
    """One row a position of each interval."""
    full = intervals.where(F.col("end") > F.col("begin"))
    return full.select("header", F.explode(F.sequence("begin", F.col("end") - 1)).alias("position"))


def table_lines(rows: DataFrame, kind: str, k: int = 21) -> DataFrame:
    """(path, segment_id, abs_pos, line): a base a line in the ``bed``, ``csvtable`` or ``csv`` form."""
    column, entry = SEPARATORS[kind]
    series = [F.concat_ws(entry, F.transform(f"{c}_k", lambda x: x.cast("string"))) for c in SERIES]
    line = F.concat_ws(column, "path", F.col("abs_pos").cast("string"), *series)
    return covering(rows, k).select("path", "segment_id", "abs_pos", line.alias("line"))


def step_lines(rows: DataFrame) -> DataFrame:
    """(path, segment_id, abs_pos, part, line): a header line for each segment, then its values."""
    heads = rows.where("pos = 0").select(
        "path", "segment_id", "abs_pos", F.lit(0).alias("part"), F.concat(F.lit("fixedStep chrom="), "path", F.lit(" start="), F.col("abs_pos").cast("string"), F.lit(" step=1")).alias("line")
    )
    values = rows.select("path", "segment_id", "abs_pos", F.lit(1).alias("part"), F.concat_ws(",", *[F.col(c).cast("string") for c in SERIES]).alias("line"))
    return heads.unionByName(values)
