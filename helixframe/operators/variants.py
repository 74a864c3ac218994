"""Variant candidates: bounded alternate walks that leave the assembly and rejoin it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import reverse_complement
from helixframe.operators.evaluate import PLACE
from helixframe.operators.graph import COUNTS
from helixframe.operators.subgraph import default_depth, looked_up, oriented_steps
from helixframe.operators.windows import segments, windows
from helixframe.scratch import materialise

SOURCE = ("path", "segment_id", "pos")
VCF_HEAD = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">']


def variants(assembly: DataFrame, dbg: DataFrame, k: int = 21, *, span: int = 5, depth: int | None = None, cutoff: int = 0, algorithm: str = "best-first", most: int | None = None) -> DataFrame:
    """(path, segment_id, pos, abs_start, type, ref_len, alt): one row an alternate walk.

    A walk starts at a present window with an edge that the assembly does not take, never steps on the
    window after it, and ends at the first of the ``span`` windows that follow the changed base. Walks of
    all sources advance together, a hop a round; a source visits a k-mer once. ``pos`` is the first
    changed base in the segment. Types: SNV, COM (equal length), DEL (bases lost), INS (a base too many).
    ``most`` keeps the shortest so many walks of a source.
    """
    hops = (default_depth(k, algorithm) if depth is None else depth) + 1
    parts = assembly if "abs_start" in assembly.columns else segments(assembly)
    rows = materialise(windows(parts, k, keep=PLACE), "windows")
    graph = dbg.select("key", *COUNTS)
    after = rows.select(*PLACE[:2], (F.col("pos") - 1).alias("pos"), F.col("key").alias("ref_key"))
    start = rows.where(F.col("pos") + k + 1 < F.col("kcount")).join(after, list(SOURCE)).select(*SOURCE, "abs_start", "ref_key", "key", F.col("kmer").alias("oriented"))
    start = materialise(start, "starts")
    steps = oriented_steps(start.join(looked_up(graph, start.select("key").distinct(), "nodes"), "key").withColumn("own", F.col("key")), cutoff)
    steps = steps.withColumn("next_key", F.least("next", reverse_complement(F.col("next")))).where("next_key <> ref_key")
    visited = materialise(steps.select(*SOURCE, F.col("own").alias("next_key")).distinct(), "visited")
    frontier = steps.select(*SOURCE, "abs_start", "ref_key", F.col("next").alias("oriented"), "next_key", F.col("base").alias("bases"))
    targets = rows.select(F.col("path").alias("t_path"), F.col("segment_id").alias("t_segment"), F.col("key").alias("t_key"), F.col("pos").alias("t_pos"))
    first = Window.partitionBy(*SOURCE, "next_key").orderBy("bases")
    found = None
    for _ in range(hops):
        frontier = frontier.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").join(visited, [*SOURCE, "next_key"], "left_anti")
        frontier = materialise(frontier, "walks")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select(*SOURCE, "next_key"))
        near = (F.col("path") == F.col("t_path")) & (F.col("segment_id") == F.col("t_segment")) & (F.col("next_key") == F.col("t_key"))
        near = near & (F.col("t_pos") > F.col("pos") + k) & (F.col("t_pos") <= F.col("pos") + k + span)
        hit = frontier.join(targets, near).groupBy(*SOURCE, "abs_start", "next_key", "bases").agg(F.min("t_pos").alias("t_pos"))
        hit = materialise(hit, "hits")
        found = hit if found is None else found.unionByName(hit)
        onward = frontier.join(hit.select(*SOURCE, "next_key"), [*SOURCE, "next_key"], "left_anti")
        onward = onward.select(*SOURCE, "abs_start", "ref_key", "bases", "oriented", F.col("next_key").alias("key"))
        onward = onward.join(looked_up(graph, onward.select("key").distinct(), "nodes"), "key")
        onward = oriented_steps(onward, cutoff).withColumn("next_key", F.least("next", reverse_complement(F.col("next")))).where("next_key <> ref_key")
        frontier = onward.select(*SOURCE, "abs_start", "ref_key", F.col("next").alias("oriented"), "next_key", F.concat("bases", "base").alias("bases"))
    if found is None:
        found = frontier.select(*SOURCE, "abs_start", "next_key", "bases", F.lit(0).cast("long").alias("t_pos")).limit(0)
    if most is not None:
        shortest = Window.partitionBy(*SOURCE).orderBy(F.length("bases"), "bases", "next_key")
        found = found.withColumn("nth", F.row_number().over(shortest)).where(F.col("nth") <= most).drop("nth")
    t = (F.col("t_pos") - F.col("pos") - k - 1).cast("int")
    inner = F.length("bases") - 1
    kind = F.when(t > 0, "COM").when(inner == k, "SNV").when(inner > k, "DEL").otherwise("INS")
    # of a longer change the last t + 1 bases before the rejoined window, which may reach into the source
    whole = F.concat("kmer", "bases")
    alt = F.when(t > 0, F.substring(whole, inner - t + 1, t + 1)).when(inner == k, F.left("bases", F.lit(1))).when(inner > k, F.left("bases", inner - k)).otherwise("")
    found = found.join(rows.select(*SOURCE, "kmer"), list(SOURCE))
    return found.select("path", "segment_id", (F.col("pos") + k).alias("pos"), "abs_start", kind.alias("type"), F.when(t > 0, t + 1).otherwise(1).alias("ref_len"), alt.alias("alt"))


def vcf_rows(found: DataFrame, assembly: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, type): positions from 1; reference bases keep their case."""
    parts = assembly if "abs_start" in assembly.columns else segments(assembly)
    raw = parts.select("path", "segment_id", "raw")
    rows = found.join(raw, ["path", "segment_id"])
    own, pair = F.substring("raw", F.col("pos") + 1, F.col("ref_len")), F.substring(F.col("raw"), F.col("pos").cast("int"), F.lit(2))
    indel = F.col("type").isin("INS", "DEL")
    alt = F.when(F.col("type") == "INS", F.left(pair, F.lit(1))).when(F.col("type") == "DEL", F.concat(F.left(pair, F.lit(1)), "alt", F.right(pair, F.lit(1)))).otherwise(F.col("alt"))
    return rows.select(F.col("path").alias("chrom"), (F.col("abs_start") + F.col("pos") + F.when(indel, 0).otherwise(1)).alias("pos"), F.when(indel, pair).otherwise(own).alias("ref"), alt.alias("alt"), "type")


def vcf_lines(rows: DataFrame) -> DataFrame:
    """(part, chrom, pos, line) of a VCF file."""
    head = [*VCF_HEAD, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"])]
    top = rows.sparkSession.createDataFrame([(i, "", 0, line) for i, line in enumerate(head)], "part int, chrom string, pos long, line string")
    body = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("0"), F.lit("PASS"), F.lit("."), F.lit("GT:GQ"), F.lit("1/1:0"))
    return top.unionByName(rows.select(F.lit(len(head)).alias("part"), "chrom", "pos", body.alias("line")))


def variant_graph(found: DataFrame, assembly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with their variants spliced in: (name, sequence) pieces and '0M' edges.

    Variants of one reference interval are alternatives; one that overlaps an earlier, different
    interval is left out. Before each site stands a piece of the segment, which may be empty.
    """
    parts = assembly if "abs_start" in assembly.columns else segments(assembly)
    own = Window.partitionBy("path", "segment_id")
    sites = found.select("path", "segment_id", F.col("pos").alias("start"), (F.col("pos") + F.when(F.col("type") == "DEL", 0).otherwise(F.col("ref_len"))).alias("stop"), "alt").distinct()
    spans = sites.select("path", "segment_id", "start", "stop").distinct()
    spans = spans.withColumn("before", F.max("stop").over(own.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.where(F.col("before").isNull() | (F.col("start") >= F.col("before")))
    order = own.orderBy("start", "stop")
    spans = spans.select("path", "segment_id", "start", "stop", (F.row_number().over(order) - 1).alias("site"), F.coalesce(F.lag("stop").over(order), F.lit(0)).alias("from"))
    spans = materialise(spans, "sites")
    name = F.concat_ws(".", "path", F.col("segment_id").cast("string"))
    raw = parts.select("path", "segment_id", "raw", F.length("raw").alias("size"))
    placed = spans.join(raw, ["path", "segment_id"])

    def piece(kind: str, number, sequence):
        return placed.select(F.concat_ws(".", name, F.lit(kind), number.cast("string")).alias("name"), sequence.alias("sequence"))

    def cut(a, b):
        return F.substring(F.col("raw"), (a + 1).cast("int"), (b - a).cast("int"))

    n = F.count("*").over(own)
    ends = placed.withColumn("n", n).where(F.col("site") == F.col("n") - 1)
    rest = ends.select(F.concat_ws(".", name, F.lit("p"), (F.col("site") + 1).cast("string")).alias("name"), cut(F.col("stop"), F.col("size")).alias("sequence"))
    alts = spans.join(sites, ["path", "segment_id", "start", "stop"]).withColumn("a", F.row_number().over(Window.partitionBy("path", "segment_id", "site").orderBy("alt")))
    alts = alts.select("path", "segment_id", "site", "a", "alt", F.concat_ws(".", name, F.lit("a"), F.col("site").cast("string"), F.col("a").cast("string")).alias("name"))
    untouched = raw.join(spans, ["path", "segment_id"], "left_anti").select(name.alias("name"), F.col("raw").alias("sequence"))
    nodes = piece("p", F.col("site"), cut(F.col("from"), F.col("start"))).unionByName(rest).unionByName(untouched)
    nodes = nodes.unionByName(piece("r", F.col("site"), cut(F.col("start"), F.col("stop"))).where("sequence <> ''")).unionByName(alts.where("alt <> ''").select("name", F.col("alt").alias("sequence")))
    before, after = F.concat_ws(".", name, F.lit("p"), F.col("site").cast("string")), F.concat_ws(".", name, F.lit("p"), (F.col("site") + 1).cast("string"))
    middle = spans.select(before.alias("u"), F.when(F.col("stop") > F.col("start"), F.concat_ws(".", name, F.lit("r"), F.col("site").cast("string"))).alias("m"), after.alias("w"))
    middle = middle.unionByName(alts.select(before.alias("u"), F.when(F.col("alt") != "", F.col("name")).alias("m"), after.alias("w")))
    pairs = F.when(F.col("m").isNull(), F.array(F.struct(F.col("u").alias("s"), F.col("w").alias("t")))).otherwise(F.array(F.struct(F.col("u").alias("s"), F.col("m").alias("t")), F.struct(F.col("m").alias("s"), F.col("w").alias("t"))))
    edges = middle.select(F.explode(pairs).alias("e")).select(F.col("e.s").alias("source"), F.lit("+").alias("source_strand"), F.col("e.t").alias("target"), F.lit("+").alias("target_strand"), F.lit("0M").alias("overlap")).distinct()
    return nodes, edges
