"""The part of the graph around an assembly: seeds, bounded searches, pruning, summary.

A frontier is joined with the graph once a hop. Its keys are written in each round, which cuts lineage, and up to
``FEW`` of them are broadcast, so the graph is read where it lies; more are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES, predecessor, reverse_complement, saturated, successor
from helixframe.operators.evaluate import PLACE, in_intervals
from helixframe.operators.graph import BACKWARD, COUNTS, EDGES, FEW, FORWARD, around, assembly_keys, build, edge_total
from helixframe.operators.windows import oriented_edges, segments, windows
from helixframe.scratch import materialise, release

FOUND, SHARED, ASSEMBLY_ONLY = 0, 1, 2
#: bases in common with an assembly that few other k-mers have
SHARED_BASES = 15


def default_depth(k: int, algorithm: str) -> int:
    if algorithm == "best-first":
        return k
    if algorithm == "traversal":
        return -(-k // 2)
    raise ValueError(f"unknown traversal algorithm {algorithm}")


def seeds(assembly: DataFrame, dbg: DataFrame, k: int = 21, *, path: str = "header", sequence: str = "sequence", reference: bool = True, intervals: DataFrame | None = None) -> DataFrame:
    """Nodes of the assembly: counts and ``colour``.

    A k-mer of the graph takes its counts once for every segment that holds it; others, unless
    ``reference`` is off, are nodes of coverage 1 with the edges of their first place in each segment.
    """
    parts = assembly if "abs_start" in assembly.columns else segments(assembly, path, sequence)
    rows = windows(parts, k, keep=PLACE).where(F.col("key").rlike(f"^[ACGT]{{{k}}}$"))
    if intervals is not None:
        rows = in_intervals(rows.withColumn("abs_pos", F.col("abs_start") + F.col("pos")), intervals)
    rows = oriented_edges(rows)
    first = rows.groupBy("path", "segment_id", "key").agg(F.min(F.struct("pos", "f_base", "b_base")).alias("m"))
    first = first.select("key", "m.f_base", "m.b_base")
    graph = dbg.select("key", *COUNTS)
    joined = first.join(graph, "key", "left" if reference else "inner")
    own = [F.when(F.col("cov").isNull(), F.lit(1)).otherwise(F.col("cov")).alias("cov")]
    for names, base in ((FORWARD, "f_base"), (BACKWARD, "b_base")):
        own += [F.when(F.col("cov").isNull(), F.when(F.col(base) == b, 1).otherwise(0)).otherwise(F.col(c)).cast("long").alias(c) for c, b in zip(names, BASES, strict=True)]
    colour = F.when(F.col("cov").isNull(), ASSEMBLY_ONLY).otherwise(SHARED)
    nodes = joined.select("key", *own, colour.alias("colour"))
    return nodes.groupBy("key").agg(*[saturated(F.sum(c)).cast("long").alias(c) for c in COUNTS], F.max("colour").cast("int").alias("colour"))


def _neighbour(column: str, base: str, forward: bool) -> Column:
    s = successor(F.col("key"), F.lit(base)) if forward else predecessor(F.col("key"), F.lit(base))
    return F.when(F.col(column) > F.col("__cut"), F.struct(F.lit(column).alias("edge"), F.col(column).alias("weight"), s.alias("next")))


def neighbours(nodes: DataFrame, cutoff: int = 0) -> DataFrame:
    """(key, edge, weight, next, next_key): a row for each edge above the cutoff."""
    options = [_neighbour(c, b, True) for c, b in zip(FORWARD, BASES, strict=True)] + [_neighbour(c, b, False) for c, b in zip(BACKWARD, BASES, strict=True)]
    rows = nodes.withColumn("__cut", F.lit(cutoff)).select("key", F.explode(F.array_compact(F.array(*options))).alias("e"))
    return rows.select("key", "e.edge", "e.weight", "e.next", F.least("e.next", reverse_complement(F.col("e.next"))).alias("next_key"))


def looked_up(graph: DataFrame, wanted: DataFrame, tag: str) -> DataFrame:
    """Rows of the graph with the columns of ``wanted`` (key, ..), written."""
    written = materialise(wanted, "wanted")
    few = written.limit(FEW + 1).count() <= FEW
    found = materialise(graph.join(F.broadcast(written) if few else written, "key"), tag)
    release(written)
    return found


def traversal(start: DataFrame, dbg: DataFrame, depth: int) -> DataFrame:
    """Breadth-first in both directions for ``depth`` rounds; all reached nodes stay, tips too."""
    reached = materialise(start, "traversal")
    frontier, graph = reached, dbg.select("key", *COUNTS)
    for _ in range(depth):
        wanted = neighbours(frontier).select(F.col("next_key").alias("key")).distinct().join(reached.select("key"), "key", "left_anti")
        frontier = looked_up(graph, wanted.withColumn("colour", F.lit(FOUND)), "frontier").select(*reached.columns)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def oriented_steps(rows: DataFrame, cutoff: int = 0) -> DataFrame:
    """(.., oriented, next): successors of each oriented k-mer ``oriented`` by the counts of its node."""
    steps = []
    for i, b in enumerate(BASES):
        straight, turned = F.col(f"fw{i}"), F.col(f"bw{3 - i}")
        count = F.when(F.col("oriented") == F.col("key"), straight).otherwise(turned)
        steps.append(F.when(count > cutoff, F.lit(b)))
    keep = [c for c in rows.columns if c not in (*COUNTS, "key")]
    out = rows.select(*keep, F.explode(F.array_compact(F.array(*steps))).alias("base"))
    return out.withColumn("next", successor(F.col("oriented"), F.col("base")))


def both_strands(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("oriented", F.explode(F.array_distinct(F.array("key", reverse_complement(F.col("key"))))))


def _hops(start: DataFrame, graph: DataFrame, depth: int, cutoff: int = 0) -> DataFrame | None:
    """(oriented, key, hop): nodes on walks from ``start``, without its own, by the length of the shortest; None without any."""
    own = start.select("key")
    oriented = oriented_steps(both_strands(start), cutoff).select(F.col("next").alias("oriented"))
    seen, frontier = None, oriented.distinct()
    for hop in range(1, depth + 1):
        keyed = frontier.withColumn("key", F.least("oriented", reverse_complement(F.col("oriented")))).join(own, "key", "left_anti")
        if seen is not None:
            keyed = keyed.join(seen.select("oriented"), "oriented", "left_anti")
        found = looked_up(graph, keyed.withColumn("hop", F.lit(hop)), "hops")
        if found.isEmpty():
            break
        seen = found.select("oriented", "key", "hop") if seen is None else seen.unionByName(found.select("oriented", "key", "hop"))
        frontier = oriented_steps(found, cutoff).select(F.col("next").alias("oriented")).distinct()
    return seen


def corridor(assembly: DataFrame, reads: DataFrame, k: int = 21, *, steps: int | None = None, path: str = "header", sequence: str = "sequence") -> DataFrame:
    """The part of the graph of ``reads``, written, that walks of at most ``steps`` steps between k-mers of the assembly can use.

    In two passes over the reads: the first and last hops of such walks are searched among k-mers that begin or end
    with ``SHARED_BASES`` bases of the assembly, and what may lie between them is then found by its two ends. Counts are whole.
    """
    steps = default_depth(k, "best-first") + 1 if steps is None else steps
    keys, ends = assembly_keys(assembly, k, path, sequence), min((steps - 1) // 2, k - SHARED_BASES)
    if ends > 0 and (near := around(keys, k, reach=ends)) is not None:
        first = materialise(build(reads, k, near=near), "near")
        start = materialise(seeds(assembly, first, k, path=path, sequence=sequence), "seeds")
        found = _hops(start, first.select("key", *COUNTS), ends)
        keys = keys if found is None else materialise(keys.select("key").unionByName(found.select("key")).distinct(), "ends")
        steps -= 2 * ends
    return materialise(build(reads, k, near=around(keys, k, walk=steps)), "dbg")


def best_first(start: DataFrame, dbg: DataFrame, depth: int, cutoff: int = 0) -> DataFrame:
    """Seeds and the nodes on walks of at most ``depth`` new nodes that leave a seed and come back to one.

    Hops from the seeds are found on oriented k-mers; those towards the seeds are, by strand symmetry, the
    hops of the reverse complement. A node lies on such a walk if both sum to at most ``depth`` + 1.
    """
    start = materialise(start, "seeds")
    graph = dbg.select("key", *COUNTS)
    seen = _hops(start, graph, depth, cutoff)
    if seen is None:
        return start
    back = seen.select(reverse_complement(F.col("oriented")).alias("oriented"), F.col("hop").alias("back"))
    kept = seen.join(back, "oriented").where(F.col("hop") + F.col("back") - 1 <= depth).select("key").distinct()
    return start.unionByName(looked_up(graph, kept.withColumn("colour", F.lit(FOUND)), "found"))


def prune_edges(nodes: DataFrame, cutoff: int = 0) -> DataFrame:
    """Edges to absent nodes, or of at most ``cutoff`` reads, become zero."""
    there = neighbours(nodes, cutoff).join(nodes.select(F.col("key").alias("next_key")), "next_key", "left_semi")
    sums = there.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("edge") == c, F.col("weight"))), F.lit(0)).alias(c) for c in EDGES])
    bare = nodes.drop(*EDGES)
    return bare.join(sums, "key", "left").select("key", "cov", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in EDGES], "colour")


def extract(
    assembly: DataFrame, dbg: DataFrame, k: int = 21, *, algorithm: str = "best-first", depth: int | None = None, cutoff: int = 0, reference: bool = True, intervals: DataFrame | None = None
) -> DataFrame:
    """Seeds, search and pruning: (key, counts, colour)."""
    hops = default_depth(k, algorithm) if depth is None else depth
    start = seeds(assembly, dbg, k, reference=reference, intervals=intervals)
    found = best_first(start, dbg, hops, cutoff) if algorithm == "best-first" else traversal(start, dbg, hops)
    return prune_edges(materialise(found, "subgraph"), cutoff)


def summary(nodes: DataFrame, k: int = 21) -> DataFrame:
    whole = F.lit(4**k).cast("decimal(20,0)") if k > 31 else F.lit(4**k)
    return nodes.agg(
        F.coalesce(F.sum("cov"), F.lit(0)).alias("total"),
        F.count_if(F.col("cov") == 1).alias("unique"),
        F.count("*").alias("distinct"),
        (whole - F.count("*")).alias("missing"),
        F.coalesce(F.sum(edge_total()), F.lit(0)).cast("long").alias("edges"),
    )


