"""The k-mer graph table: key, cov, fw0..fw3, bw0..bw3; built, merged and summarised."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.bases import saturated
from helixframe.operators import packed
from helixframe.operators.windows import segments, windows
from helixframe.scratch import materialise

FORWARD, BACKWARD = [f"fw{i}" for i in range(4)], [f"bw{i}" for i in range(4)]
EDGES = FORWARD + BACKWARD
COUNTS = ["cov", *EDGES]
#: k-mers that are broadcast at most, alone and with all their infixes: some 5 and 16 MB
FEW, NEAR = 1 << 19, 1 << 18


def check_k(k: int) -> None:
    if not 0 < k <= 32:
        raise ValueError(f"k must be 1 to 32, not {k}")


def build(reads: DataFrame, k: int = 21, sequence: str = "sequence", only: DataFrame | None = None, near: Callable | None = None) -> DataFrame:
    """Count the canonical k-mers of ``reads`` with their neighbours: packed blocks, one shuffle of them.

    ``only`` (key) keeps those k-mers alone, as ``assembly_keys`` makes them. Up to ``FEW`` of them are broadcast and
    filter the windows before anything is shuffled; more are joined with the counts. ``near`` keeps what ``around`` says.
    """
    check_k(k)
    few = only is not None and only.limit(FEW + 1).count() <= FEW
    blocks = packed.partial(reads, k, sequence, packed.Only(packed.collected(only, k)) if few else near)
    out = packed.total(blocks, k)
    if only is not None and not few:
        return out.join(only.select("key"), "key", "left_semi")
    out.blocks, out.blocks_k = blocks, k
    return out


def around(keys: DataFrame, k: int = 21, *, walk: int | None = None, reach: int | None = None, within: int | None = None) -> Callable | None:
    """For ``build``: what lies on walks of at most ``walk`` steps between the k-mers of a written table ``keys``, or at
    most ``reach`` steps along a strand, or ``within`` steps in any direction, from one.

    The filter is broadcast; around more than ``NEAR`` k-mers the whole graph is to be built (None).
    """
    return packed.around(keys, k, walk=walk, reach=reach, within=within) if keys.limit(NEAR + 1).count() <= NEAR else None


def assembly_keys(assembly: DataFrame, k: int = 21, path: str = "header", sequence: str = "sequence") -> DataFrame:
    """The distinct canonical k-mers of an assembly, written, so that their number is known before they are used."""
    parts = assembly if "abs_start" in assembly.columns else segments(assembly, path, sequence)
    return materialise(windows(parts, k).select("key").distinct(), "assembly-keys")


def _saturated(dbg: DataFrame) -> DataFrame:
    return dbg.select("key", *[saturated(F.col(c)).cast("long").alias(c) for c in COUNTS])


def merge(dbgs: list[DataFrame], k: int | None = None) -> DataFrame:
    """Sum of several graphs of one k, each count saturating.

    Graphs as ``build`` returns them are summed from their blocks: a sum of saturating sums is the saturating sum.
    With ``k`` others are packed first; else their rows meet by key.
    """
    if len(dbgs) < 2:
        raise ValueError("a union takes two graphs or more")
    own = {getattr(d, "blocks_k", k) for d in dbgs}
    if len(own) == 1 and None not in own:
        size = own.pop()
        return packed.total(reduce(DataFrame.unionByName, [d.blocks if hasattr(d, "blocks") else packed.of_graph(d, size) for d in dbgs]), size)
    rows = reduce(DataFrame.unionByName, [d.select("key", *COUNTS) for d in dbgs])
    return _saturated(rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def edge_total() -> Column:
    """Bases by which a node goes on at either end: a base counts once for both directions."""
    parts = [F.when((F.col(f) > 0) | (F.col(b) > 0), 1).otherwise(0) for f, b in zip(FORWARD, BACKWARD, strict=True)]
    return sum(parts[1:], parts[0])


def edge_slots() -> Column:
    parts = [F.when(F.col(c) > 0, 1).otherwise(0) for c in EDGES]
    return sum(parts[1:], parts[0])


def forward_count() -> Column:
    parts = [F.when(F.col(c) > 0, 1).otherwise(0) for c in FORWARD]
    return sum(parts[1:], parts[0])


def backward_count() -> Column:
    parts = [F.when(F.col(c) > 0, 1).otherwise(0) for c in BACKWARD]
    return sum(parts[1:], parts[0])


def stats(dbg: DataFrame, k: int = 21) -> DataFrame:
    """One row: total, unique, distinct and missing k-mers, edges, and occupied edge slots."""
    check_k(k)
    out = dbg.agg(
        F.coalesce(F.sum("cov"), F.lit(0)).cast("long").alias("total"),
        F.count_if(F.col("cov") == 1).alias("unique"),
        F.count("*").alias("distinct"),
        F.coalesce(F.sum(edge_total()), F.lit(0)).cast("long").alias("edges"),
        F.coalesce(F.sum(edge_slots()), F.lit(0)).cast("long").alias("edge_slots"),
    )
    whole = F.lit(4**k).cast("decimal(20,0)") if k > 31 else F.lit(4**k)
    return out.select("total", "unique", "distinct", (whole - F.col("distinct")).cast("decimal(20,0)" if k > 31 else "long").alias("missing"), "edges", "edge_slots")


def histogram(dbg: DataFrame) -> DataFrame:
    """Coverage and the number of k-mers that have it."""
    return dbg.groupBy("cov").agg(F.count("*").alias("n_kmers"))
