"""Graph export: nodes and edges, maximal unbranched paths, and graph summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES, colour_name, reverse_complement, successor
from helixframe.operators.components import connected_components
from helixframe.operators.subgraph import both_strands, neighbours
from helixframe.scratch import materialise

#: k-mers of a path that are put together at once
RUN = 1 << 12


def node_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uncollapsed export: (name, sequence, depth, colour) a node, and each edge from both of its ends."""
    out = nodes.select(F.col("key").alias("name"), F.col("key").alias("sequence"), F.col("cov").cast("double").alias("depth"), colour_name(F.col("colour")).alias("colour"))
    rows = neighbours(nodes)
    forward = F.col("edge").startswith("fw")
    same = F.col("next") == F.col("next_key")
    edges = rows.select(
        F.col("key").alias("source"),
        F.when(forward, "+").otherwise("-").alias("source_strand"),
        F.col("next_key").alias("target"),
        F.when(forward == same, "+").otherwise("-").alias("target_strand"),
        F.col("weight").alias("count"),
    )
    return out, edges


def _links(nodes: DataFrame) -> DataFrame:
    """(a, b, count): steps between oriented k-mers, on both strands.

    A node that only the assembly has knows its edges, while its neighbours in the reads don't know theirs to it: a step
    that either of its ends knows is one on both strands, with the larger count.
    """
    rows = both_strands(nodes)
    steps = []
    for i, b in enumerate(BASES):
        count = F.when(F.col("oriented") == F.col("key"), F.col(f"fw{i}")).otherwise(F.col(f"bw{3 - i}"))
        steps.append(F.when(count > 0, F.struct(F.lit(b).alias("base"), count.alias("count"))))
    out = rows.select(F.col("oriented").alias("a"), F.explode(F.array_compact(F.array(*steps))).alias("s"))
    known = out.select("a", successor(F.col("a"), F.col("s.base")).alias("b"), F.col("s.count").alias("count"))
    ways = F.array(F.struct("a", "b"), F.struct(reverse_complement(F.col("b")).alias("a"), reverse_complement(F.col("a")).alias("b")))
    return known.select(F.explode(ways).alias("w"), "count").groupBy("w").agg(F.max("count").alias("count")).select("w.a", "w.b", "count")


def _heads(all_: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, head, offset, low, open): pointer doubling along inner links; ``open`` where a cycle has no head."""
    up = all_.join(inner.select(F.col("b").alias("node"), F.col("a").alias("prev")), "node", "left")
    state = up.select("node", F.coalesce("prev", "node").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("offset"), F.least("node", F.coalesce("prev", "node")).alias("low"), F.col("prev").isNotNull().alias("open"))
    state = materialise(state, "heads")
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        above = state.select(F.col("node").alias("h"), F.col("head").alias("head2"), F.col("offset").alias("offset2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        moved = state.join(above, state["head"] == F.col("h"))
        state = materialise(
            moved.select("node", F.col("head2").alias("head"), (F.col("offset") + F.when(F.col("node") == F.col("head"), 0).otherwise(F.col("offset2"))).alias("offset"), F.least("low", "low2").alias("low"), (F.col("open") & F.col("open2")).alias("open")),
            "heads",
        )
        if state.where("open").isEmpty():
            break
    return state


def unitigs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maximal unbranched paths (name, sequence, n_kmers, depth, colour) and the edges between them.

    A step is inner if it is the only one out of its start and the only one into its end. Heads are
    found in a logarithmic number of joins; a cycle is cut before its smallest k-mer. The two strands
    of a path are one unitig, written as the smaller sequence. Depth is the mean coverage.
    """
    links = materialise(_links(nodes), "links")
    out_one = links.groupBy("a").agg(F.count("*").alias("n"), F.first("b").alias("b")).where("n = 1").select("a", "b")
    in_one = links.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    inner = materialise(out_one.join(in_one, "b").where(F.col("b") != reverse_complement(F.col("a"))).select("a", "b"), "inner")
    all_ = materialise(both_strands(nodes).select(F.col("oriented").alias("node"), "cov", "colour"), "strands")
    state = _heads(all_.select("node"), inner)
    cycles = materialise(state.where("open").select("node", "low"), "cycles")
    if not cycles.isEmpty():
        # one cut for both strands of a cycle: before the smaller of their smallest k-mers, and its mirror image
        lows = cycles.select("low").distinct().withColumn("turned", reverse_complement(F.col("low")))
        other = cycles.select(F.col("node").alias("turned"), F.col("low").alias("other"))
        starts = lows.join(other, "turned").where(F.col("low") <= F.col("other")).select(F.col("low").alias("b"))
        mirrored = starts.join(inner, "b").select(reverse_complement(F.col("b")).alias("a"), reverse_complement(F.col("a")).alias("b")).select("b")
        inner = materialise(inner.join(starts.unionByName(mirrored).distinct(), "b", "left_anti"), "inner")
        state = _heads(all_.select("node"), inner)
    state = materialise(state.select("node", "head", "offset"), "placed")
    # a path is put together in two steps, so that no group of one step grows with its length: runs of offsets, then their texts
    last = F.substring("node", -1, 1)
    runs = state.join(all_, "node").groupBy("head", F.floor(F.col("offset") / RUN).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("offset", last.alias("base")))).alias("v"), F.count("*").alias("n"), F.sum("cov").alias("covs"), F.max("colour").alias("colour"), F.max(F.struct("offset", "node")).alias("end")
    )
    text = F.array_join(F.transform(F.filter("v", lambda x: x["offset"] > 0), lambda x: x["base"]), "")
    paths = runs.select("head", "n", "covs", "colour", "end", F.struct("run", text.alias("text")).alias("part")).groupBy("head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("rest"), F.sum("n").alias("n_kmers"), F.sum("covs").alias("covs"), F.max("colour").alias("colour"), F.max("end")["node"].alias("tail")
    )
    paths = paths.select("head", "tail", "n_kmers", (F.col("covs") / F.col("n_kmers")).alias("depth"), "colour", F.concat("head", "rest").alias("sequence"))
    paths = paths.withColumn("name", F.least("sequence", reverse_complement(F.col("sequence")))).withColumn("strand", F.when(F.col("sequence") == F.col("name"), "+").otherwise("-"))
    paths = materialise(paths, "paths")
    out = paths.where("strand = '+'").select("name", "sequence", "n_kmers", F.round("depth", 6).alias("depth"), colour_name(F.col("colour")).alias("colour"))
    ends, starts = paths.select(F.col("tail").alias("a"), F.col("name").alias("source"), F.col("strand").alias("source_strand")), paths.select(F.col("head").alias("b"), F.col("name").alias("target"), F.col("strand").alias("target_strand"))
    edges = links.join(ends, "a").join(starts, "b").select("source", "source_strand", "target", "target_strand", "count")
    turn = {"source_strand": "target_strand", "target_strand": "source_strand"}
    mirror = F.struct(F.col("target").alias("s"), *[F.when(F.col(c) == "+", "-").otherwise("+").alias(f"x{i}") for i, c in enumerate([turn["source_strand"]])], F.col("source").alias("t"), F.when(F.col("source_strand") == "+", "-").otherwise("+").alias("y"))
    straight = F.struct(F.col("source").alias("s"), F.col("source_strand").alias("x0"), F.col("target").alias("t"), F.col("target_strand").alias("y"))
    edges = edges.select(F.least(straight, mirror).alias("e"), "count").groupBy("e").agg(F.max("count").alias("count"))
    return out, edges.select(F.col("e.s").alias("source"), F.col("e.x0").alias("source_strand"), F.col("e.t").alias("target"), F.col("e.y").alias("target_strand"), "count")


def graph_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, label): the smallest name reachable."""
    found = connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    found = found.select(F.col("node").alias("l_name"), "label")
    return nodes.select("name").join(found, F.col("name") == F.col("l_name"), "left").select("name", F.coalesce("label", "name").alias("label"))


def _sides(edges: DataFrame) -> DataFrame:
    """(name, side, other, other_side): each edge seen from both ends; R is where a '+' step leaves."""
    def side(strand: str, leaves: bool):
        return F.when((F.col(strand) == "+") == F.lit(leaves), "R").otherwise("L")

    one = edges.select(F.col("source").alias("name"), side("source_strand", True).alias("side"), F.col("target").alias("other"), side("target_strand", False).alias("other_side"))
    two = one.select(F.col("other").alias("name"), F.col("other_side").alias("side"), F.col("name").alias("other"), F.col("side").alias("other_side"))
    return one.unionByName(two).distinct()


def bubbles(edges: DataFrame) -> DataFrame:
    """(start, end, arms): a fork whose two unbranched arms meet again, where the graph goes on beyond one of its ends."""
    sides = materialise(_sides(edges), "sides")
    degree = sides.groupBy("name", "side").agg(F.count("*").alias("n"))
    single = degree.where("n = 1").groupBy("name").agg(F.count("*").alias("s")).where("s = 2").select("name")
    left = sides.where("side = 'L'").join(single, "name", "left_semi").select("name", F.col("other").alias("u"), F.col("other_side").alias("us"))
    right = sides.where("side = 'R'").join(single, "name", "left_semi").select("name", F.col("other").alias("w"), F.col("other_side").alias("ws"))
    arms = left.join(right, "name").where(F.struct("u", "us") != F.struct("w", "ws"))
    ends = arms.select(F.least(F.struct(F.col("u").alias("n"), F.col("us").alias("s")), F.struct(F.col("w").alias("n"), F.col("ws").alias("s"))).alias("a"), F.greatest(F.struct(F.col("u").alias("n"), F.col("us").alias("s")), F.struct(F.col("w").alias("n"), F.col("ws").alias("s"))).alias("b"))
    found = ends.groupBy("a", "b").agg(F.count("*").alias("arms")).where("arms >= 2")
    full = degree.select(F.col("name").alias("d_name"), F.col("side").alias("d_side"), "n")
    outer = found
    for end in ("a", "b"):
        across = F.when(F.col(f"{end}.s") == "R", "L").otherwise("R")
        outer = outer.join(full, (F.col(f"{end}.n") == F.col("d_name")) & (across == F.col("d_side")), "left").withColumn(f"on_{end}", F.col("n").isNotNull()).drop("d_name", "d_side", "n")
    return outer.where("on_a or on_b").select(F.col("a.n").alias("start"), F.col("b.n").alias("end"), "arms")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: segments without any edge, and their length."""
    touched = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return nodes.join(touched, "name", "left_anti").agg(F.count("*").alias("segments"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("total_length"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: segments, lengths, edges, degree, components, dead ends, bubbles and circular segments."""
    sized = nodes.select("name", F.length("sequence").cast("long").alias("length"))
    labels = graph_labels(nodes, edges).join(sized, "name").groupBy("label").agg(F.sum("length").alias("bases"), F.count("*").alias("segments"))
    parts = labels.agg(F.count("*").alias("components"), F.coalesce(F.max("bases"), F.lit(0)).alias("largest_component"))
    sides = _sides(edges).select("name", "side").distinct().groupBy("name").agg(F.count("*").alias("sides"))
    ends = sized.join(sides, "name", "left").agg(F.coalesce(F.sum(2 - F.coalesce("sides", F.lit(0))), F.lit(0)).alias("dead_ends"), F.count("*").alias("segments"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))
    lines = edges.agg(F.count("*").alias("edges"), F.count_if((F.col("source") == F.col("target")) & (F.col("source_strand") == F.col("target_strand"))).alias("circular"))
    found = bubbles(edges).agg(F.count("*").alias("bubbles"))
    row = ends.crossJoin(parts).crossJoin(lines).crossJoin(found)  # one row each
    average = F.when(F.col("segments") > 0, F.col("total_length") / F.col("segments"))
    degree = F.when(F.col("segments") > 0, F.col("edges") / F.col("segments"))
    return row.select("segments", "total_length", average.alias("average_length"), "edges", degree.alias("average_degree"), "components", "largest_component", "dead_ends", "bubbles", "circular")


def gfa_lines(nodes: DataFrame, edges: DataFrame, k: int = 21) -> DataFrame:
    """(part, line) of a GFA 1 file with depth, colour and edge count tags."""
    tags = [F.concat(F.lit("DP:f:"), F.col("depth").cast("string")), F.concat(F.lit("CB:Z:"), "colour")]
    rows = nodes.select("name", "sequence", F.concat_ws("\t", *tags).alias("tags"))
    links = edges.select("source", "source_strand", "target", "target_strand", F.lit(k - 1).alias("overlap"), F.concat(F.lit("KC:i:"), F.col("count").cast("string")).alias("tags"))
    return graph_lines(rows, links, 1)


def graph_lines(nodes: DataFrame, edges: DataFrame, version: int) -> DataFrame:
    """(part, line) of a GFA file of ``version`` 1 or 2 for (name, sequence, tags) and (source, .., overlap, tags).

    In GFA 2 segments state their length, and edges the ends that overlap: the end of the source as it is
    walked, and the start of the target; ``$`` marks a segment's last position.
    """
    head = nodes.sparkSession.createDataFrame([(0, f"H\tVN:Z:{'1.2' if version == 1 else '2.0'}")], "part int, line string")
    sequence = F.when(F.col("sequence") == "", "*").otherwise(F.col("sequence"))

    def line(part: int, *fields) -> list:
        return [F.lit(part).alias("part"), F.concat_ws("\t", *fields, F.when(F.col("tags") != "", F.col("tags"))).alias("line")]

    if version == 1:
        s = nodes.select(*line(1, F.lit("S"), "name", sequence))
        e = edges.select(*line(2, F.lit("L"), "source", "source_strand", "target", "target_strand", F.concat(F.col("overlap").cast("string"), F.lit("M"))))
        return head.unionByName(s).unionByName(e)
    sizes = nodes.select("name", F.length("sequence").alias("size"))
    s = nodes.select(*line(1, F.lit("S"), "name", F.length("sequence").cast("string"), sequence))
    sized = edges.join(sizes.select(F.col("name").alias("source"), F.col("size").alias("a_size")), "source").join(sizes.select(F.col("name").alias("target"), F.col("size").alias("b_size")), "target")

    def span(size: str, at_end) -> list:
        end, whole = F.when(at_end, F.col(size)).otherwise(F.col("overlap")), F.col(size).cast("string")
        begin = F.when(at_end, F.col(size) - F.col("overlap")).otherwise(F.lit(0))
        marked = [F.when(x == F.col(size), F.concat(whole, F.lit("$"))).otherwise(x.cast("string")) for x in (begin, end)]
        return marked

    ends = [*span("a_size", F.col("source_strand") == "+"), *span("b_size", F.col("target_strand") == "-")]
    e = sized.select(*line(2, F.lit("E"), F.lit("*"), F.concat("source", "source_strand"), F.concat("target", "target_strand"), *ends, F.concat(F.col("overlap").cast("string"), F.lit("M"))))
    return head.unionByName(s).unionByName(e)
