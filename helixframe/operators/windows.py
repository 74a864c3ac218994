"""Segments, k-windows and oriented edges of sequences: narrow operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import complement, reverse_complement

#: windows of a piece after the first and after the second cut
CHUNK, PIECE = 1 << 12, 1 << 6
TURNS = "(?<=[^Nn])(?=[Nn])|(?<=[Nn])(?=[^Nn])"


def segments(sequences: DataFrame, path: str = "header", sequence: str = "sequence") -> DataFrame:
    """(path, segment_id, abs_start, seq, length): runs without N, in order, with their offsets in the path.

    ``seq`` is in upper case, ``raw`` keeps the case. Segment numbers start at 0 in each path.
    """
    runs = sequences.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(sequence), TURNS)).alias("run", "raw"))
    order = Window.partitionBy("path").orderBy("run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.lower(F.left("raw", F.lit(1))) == "n"
    placed = runs.withColumn("abs_start", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("long"))
    placed = placed.withColumn("segment_id", F.sum(F.when(gap, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    placed = placed.where(~gap & (F.length("raw") > 0))
    return placed.select("path", F.col("segment_id").cast("long"), "abs_start", F.upper("raw").alias("seq"), "raw", F.length("raw").cast("long").alias("length"))


def components(sequences: DataFrame, path: str = "header", sequence: str = "sequence") -> DataFrame:
    """(path, comp_idx, kind, abs_start, length): segments and gaps in path order with running offsets."""
    runs = sequences.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(sequence), TURNS)).alias("comp_idx", "raw"))
    before = Window.partitionBy("path").orderBy("comp_idx").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.lower(F.left("raw", F.lit(1))) == "n", "GAP").otherwise("SEGMENT")
    out = runs.select("path", "comp_idx", kind.alias("kind"), F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("long").alias("abs_start"), F.length("raw").cast("long").alias("length"))
    return out.where("length > 0")


def fragments(reads: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(seq): runs of A, C, G, T of every read; no k-mer crosses another character."""
    return reads.select(F.explode(F.split(F.upper(F.coalesce(F.col(sequence), F.lit(""))), "[^ACGT]+")).alias("seq"))


def windows(rows: DataFrame, k: int, *, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """One row a k-window of ``seq``: ``keep``, pos, kcount, kmer, key, is_fw, left and right base.

    A generator copies its input into every row it makes, so a sequence is first cut into overlapping pieces, in two steps, and only
    the short pieces are carried to the positions; bytes are sliced in constant time. With ``whole`` the last
    k - 1 positions appear too, with null k-mer.
    """
    n = F.length("seq")
    last = n - 1 if whole else n - k
    base = rows.where(n >= k).select(*keep, F.encode("seq", "utf-8").alias("bytes"), F.lit(0).alias("at"), F.lit(0).alias("first"), last.alias("last"), n.alias("size"))
    for step in (CHUNK, PIECE):
        base = _pieces(base, step, k, keep)
    base = base.withColumn("turned", F.encode(reverse_complement(F.col("bytes").cast("string")), "utf-8"))
    base = base.select("*", F.explode(F.sequence("first", "last")).alias("pos"))
    p, size = F.col("pos"), F.col("size")
    at = p - F.col("at")  # from 0 in the piece

    def part(source: str, begin: Column, length: int) -> Column:
        return F.substring(F.col(source), begin, F.lit(length)).cast("string")

    kmer, rc = part("bytes", at + 1, k), part("turned", F.length("bytes") - at - k + 1, k)
    if whole:
        kmer, rc = F.when(p <= size - k, kmer), F.when(p <= size - k, rc)
    return base.select(
        *keep,
        p.cast("long").alias("pos"),
        (size - k + 1).cast("long").alias("kcount"),
        kmer.alias("kmer"),
        F.least(kmer, rc).alias("key"),
        (kmer <= rc).alias("is_fw"),
        F.when(p > 0, part("bytes", at, 1)).alias("left"),
        F.when(p + k < size, part("bytes", at + k + 1, 1)).alias("right"),
    )


def _pieces(rows: DataFrame, step: int, k: int, keep: tuple[str, ...]) -> DataFrame:
    """Cut pieces (bytes from base ``at``; windows ``first`` to ``last``) into those of ``step`` windows, each with the base before and after."""
    def piece(first: Column) -> Column:
        at = F.greatest(first - 1, F.lit(0))
        own = F.substring(F.col("bytes"), at - F.col("at") + 1, first - at + F.lit(step + k))
        return F.struct(own.alias("bytes"), at.alias("at"), first.alias("first"), F.least(first + (step - 1), F.col("last")).alias("last"))

    made = F.transform(F.sequence(F.col("first"), F.col("last"), F.lit(step)), piece)
    return rows.select(*keep, "size", F.explode(made).alias("piece")).select(*keep, "size", "piece.*")


def oriented_edges(rows: DataFrame) -> DataFrame:
    """Adds f_base and b_base: the window's right and left neighbours seen from its key."""
    fw = F.when(F.col("is_fw"), F.col("right")).otherwise(complement(F.col("left")))
    bw = F.when(F.col("is_fw"), F.col("left")).otherwise(complement(F.col("right")))
    return rows.withColumn("f_base", fw).withColumn("b_base", bw)
