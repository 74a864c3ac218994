"""Command line: validate, union, subgraph, inflate and lookup."""

from __future__ import annotations

import argparse
import gzip
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import assembly, evaluate, graph, subgraph, tracks, unitigs, variants, windows
from helixframe.scratch import materialise
from helixframe.sources import binary_track, database, sequences

GRAPH_KINDS, TABLE_KINDS = ("gfa", "gfa2", "gfa.gz", "gfa2.gz"), ("bed", "csv", "csvtable")


def extension(path: str) -> str:
    """Last extension, with the one before ``.gz``; the name itself where it has no dot."""
    name = os.path.basename(path)
    parts = name.split(".")
    return ".".join(parts[-2:]) if len(parts) > 2 and parts[-1] == "gz" else parts[-1]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    modes = top.add_subparsers(dest="mode", required=True)
    check = modes.add_parser("validate", help="score an assembly, or build a graph")
    check.add_argument("-f", "--input-sequence")
    check.add_argument("-r", "--input-reads", nargs="+")
    check.add_argument("-d", "--input-db")
    check.add_argument("-k", "--kmer-length", type=int, default=21)
    check.add_argument("-c", "--coverage-cutoff", type=int, default=0)
    check.add_argument("-p", "--input-positions")
    check.add_argument("--search-depth", type=int)
    check.add_argument("--max-span", type=int, default=5)
    check.add_argument("-o", "--out", default="")
    union = modes.add_parser("union", help="sum several graphs")
    union.add_argument("-d", "--input-db", nargs="+", required=True)
    union.add_argument("-o", "--out", default="")
    part = modes.add_parser("subgraph", help="extract the graph around an assembly")
    part.add_argument("-f", "--input-sequence", required=True)
    part.add_argument("-d", "--input-db", required=True)
    part.add_argument("-p", "--input-positions")
    part.add_argument("-c", "--coverage-cutoff", type=int, default=0)
    part.add_argument("--traversal-algorithm", default="best-first")
    part.add_argument("--search-depth", type=int)
    part.add_argument("--no-collapse", action="store_true")
    part.add_argument("--no-reference", action="store_true")
    part.add_argument("-o", "--out", default="")
    inflate = modes.add_parser("inflate", help="print a binary track")
    find = modes.add_parser("lookup", help="print ranges of a binary track")
    for p in (inflate, find):
        p.add_argument("-i", "--input-file", required=True)
        p.add_argument("--expand", action="store_true")
    find.add_argument("-c", "--coordinate-file")
    find.add_argument("-s", "--span", type=int, default=0)
    find.add_argument("coordinate", nargs="?")
    for p in (check, union, part, inflate, find):
        p.add_argument("--parts", action="store_true", help="write text outputs as a folder of files, by the executors")
        p.add_argument("-j", "--threads", type=int)
        p.add_argument("-m", "--max-memory", type=float)
        p.add_argument("-t", "--tmp-prefix")
        p.add_argument("--verbose", action="store_true")
    return top


def report(dbg: DataFrame, k: int) -> None:
    s = graph.stats(dbg, k).first()
    print(f"Total kmers: {s.total}\nUnique kmers: {s.unique}\nDistinct kmers: {s.distinct}\nMissing kmers: {s.missing}\nTotal edges: {s.edges}")


def put(lines: DataFrame, order: list[str], path: str, head: str = "", parts: bool = False) -> None:
    """Ordered lines to a file (packed where its name ends in ``.gz``), or to the screen where the name has no dot.

    One file, like the screen, takes one partition at a time through the driver. With ``parts`` the
    executors write a folder of files instead, whose names are in the order of the lines.
    """
    if parts and "." in path:
        first = lines.sparkSession.createDataFrame([(line,) for line in head.splitlines()], "line string").coalesce(1)
        ordered = lines.orderBy(*order).select("line")
        out = (first.unionByName(ordered) if head else ordered).write.mode("overwrite")
        out.text(path, compression="gzip" if path.endswith(".gz") else "none")
        return
    rows = lines.orderBy(*order).select("line").toLocalIterator()
    if "." not in path:
        print(head, end="")
        for r in rows:
            print(r["line"])
        return
    with gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w") as out:
        out.write(head)
        out.writelines(r["line"] + "\n" for r in rows)


def graph_version(path: str) -> int:
    return 2 if extension(path).startswith("gfa2") else 1


def report_assembly(segments: DataFrame, edges: DataFrame) -> None:
    """The assembly summary of a graph without paths: scaffolds, contigs and gaps are none."""
    s = unitigs.graph_summary(segments, edges).first()
    alone = unitigs.isolated(segments, edges).first()
    for kind, title, plural, average in (("scaffold", "Scaffold", "scaffolds", "nan"), ("contig", "Contig", "contigs", "nan"), ("gap", "Gap", "gaps in scaffolds", "0.00")):
        tail = " in scaffolds" if kind == "gap" else ""
        rows = [f"# {plural}", f"Total {kind} length{tail}", f"Average {kind} length{tail}", f"{title} N50{tail}", f"{title} auN{tail}", f"{title} L50{tail}", f"Largest {kind}{tail}", f"Smallest {kind}{tail}"]
        values = ["0", "0", average, "0", "0.00", "0", "0", "0"]
        if kind == "scaffold":
            print("+++Assembly summary+++: ")
        print("\n".join(f"{r}: {v}" for r, v in zip(rows, values, strict=True)))
    print("Base composition (A:C:G:T): 0:0:0:0\nGC content %: nan\n# soft-masked bases: 0")
    mean, degree = (f"{x:.2f}" if x is not None else "nan" for x in (s.average_length, s.average_degree))
    print(f"# segments: {s.segments}\nTotal segment length: {s.total_length}\nAverage segment length: {mean}\n# gaps: 0\n# paths: 0\n# edges: {s.edges}\nAverage degree: {degree}")
    print(f"# connected components: {s.components - alone.segments}\nLargest connected component length: {s.largest_component}\n# dead ends: {s.dead_ends}")
    print(f"# disconnected components: {alone.segments}\nTotal length disconnected components: {alone.total_length}\n# separated components: {s.components}")
    print(f"# bubbles: {s.bubbles}\n# circular segments: {s.circular}\n# circular paths: 0")


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    if bool(a.input_db) == bool(a.input_reads):
        raise ValueError("give reads or one graph")
    if a.input_db:
        dbg, k = database.load(spark, a.input_db)
    else:
        k = a.kmer_length
        dbg = materialise(graph.build(sequences.read_sequences(spark, a.input_reads), k), "dbg")
    kind, shown = extension(a.out), not a.out or "." in a.out
    if kind == "hist":
        put(graph.histogram(dbg).select("cov", F.concat_ws("\t", F.col("cov").cast("string"), F.col("n_kmers").cast("string")).alias("line")), ["cov"], a.out, parts=a.parts)
    if kind == "helix":
        database.save(dbg, a.out, k)
    if shown:
        report(dbg, k)
    if not a.input_sequence:
        return
    asm = sequences.read_assembly(spark, a.input_sequence)
    if kind == "vcf" or kind in GRAPH_KINDS:
        found = materialise(variants.variants(asm, dbg, k, span=a.max_span, depth=a.search_depth, cutoff=a.coverage_cutoff), "variants")
        if kind == "vcf":
            put(variants.vcf_lines(variants.vcf_rows(found, asm)), ["part", "chrom", "pos"], a.out, parts=a.parts)
        else:
            nodes, edges = variants.variant_graph(found, asm)
            lines = unitigs.graph_lines(nodes.withColumn("tags", F.lit("")), edges.withColumn("overlap", F.lit(0)).withColumn("tags", F.lit("")), graph_version(a.out))
            put(lines, ["part", "line"], a.out, parts=a.parts)
        return
    bed = sequences.read_bed(spark, a.input_positions) if a.input_positions else None
    rows = materialise(evaluate.track(asm, dbg, k, whole=True, intervals=bed), "track")
    if shown:
        print("Missing\tTotal\tQV\tError\tk\tMethod")
        for r in evaluate.scores(rows, k, a.coverage_cutoff).orderBy(F.col("method").desc()).collect():
            print(f"{r.missing}\t{r.total}\t{r.qv:.6g}\t{r.error:.6g}\t{k}\t{r.method}")
    place = ["path", "abs_pos"]
    if kind in TABLE_KINDS:
        put(tracks.table_lines(rows, kind, k), place, a.out, parts=a.parts)
    elif kind == "kwig":
        put(tracks.step_lines(rows), ["path", "segment_id", "part", "abs_pos"], a.out, f"{k}\n", a.parts)
    elif kind == "bkwig":
        binary_track.write_binary_track(rows, a.out, k)


def union(spark: SparkSession, a: argparse.Namespace) -> None:
    dbgs, k = database.load_same_k(spark, a.input_db)
    merged = materialise(graph.merge(dbgs, k), "union")
    if a.out:
        database.save(merged, a.out, k)
    report(merged, k)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    dbg, k = database.load(spark, a.input_db)
    asm = sequences.read_assembly(spark, a.input_sequence)
    bed = sequences.read_bed(spark, a.input_positions) if a.input_positions else None
    found = subgraph.extract(asm, dbg, k, algorithm=a.traversal_algorithm, depth=a.search_depth, cutoff=a.coverage_cutoff, reference=not a.no_reference, intervals=bed)
    nodes = materialise(found, "subgraph")
    own = subgraph.summary(nodes, k).first()
    print("Subgraph summary statistics:")
    print(f"Total kmers: {own.total}\nUnique kmers: {own.unique}\nDistinct kmers: {own.distinct}\nMissing kmers: {own.missing}\nTotal edges: {own.edges}")
    segments, edges = unitigs.node_graph(nodes) if a.no_collapse else unitigs.unitigs(nodes)
    segments, edges = materialise(segments, "segments"), materialise(edges, "edges")
    report_assembly(segments, edges)
    print("DBG Summary statistics:")
    report(dbg, k)
    if extension(a.out) in GRAPH_KINDS:
        rows = segments.select("name", "sequence", F.concat_ws("\t", F.concat(F.lit("DP:f:"), F.col("depth").cast("string")), F.concat(F.lit("CB:Z:"), "colour")).alias("tags"))
        links = edges.select("source", "source_strand", "target", "target_strand", F.lit(k - 1).alias("overlap"), F.concat(F.lit("KC:i:"), F.col("count").cast("string")).alias("tags"))
        put(unitigs.graph_lines(rows, links, graph_version(a.out)), ["part", "line"], a.out, parts=a.parts)


def inflate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = binary_track.read_binary_track(spark, a.input_file)
    k = (rows.select("k").first() or [21])[0]
    if a.expand:
        put(tracks.table_lines(rows, "csvtable", k), ["path", "abs_pos"], "")
    else:
        put(tracks.step_lines(rows), ["path", "segment_id", "part", "abs_pos"], "", f"{k}\n")


def lookup(spark: SparkSession, a: argparse.Namespace) -> None:
    if bool(a.coordinate) == bool(a.coordinate_file):
        raise ValueError("give one coordinate or a file of them")
    rows = binary_track.read_binary_track(spark, a.input_file)
    k = (rows.select("k").first() or [21])[0]
    wanted = sequences.read_bed(spark, a.coordinate_file) if a.coordinate_file else sequences.parse_coordinate(spark, a.coordinate)
    absent = wanted.join(rows.select(F.col("path").alias("header")).distinct(), "header", "left_anti").head(1)
    if absent:
        raise ValueError(f"no path {absent[0]['header']}")
    values = tracks.covering(rows, k) if a.expand else rows
    last = None
    print(k)
    for r in tracks.lookup(values, wanted, a.span).orderBy("path", "begin", "end", "abs_pos").toLocalIterator():
        if (r["path"], r["begin"], r["end"]) != last:
            print(("\n" if last else "") + f"{r['path']}:{r['first'] + 1}-{r['stop'] + 1}")
            last = (r["path"], r["begin"], r["end"])
        series = [",".join(map(str, r[f"{c}_k"])) for c in tracks.SERIES] if a.expand else [str(r[c]) for c in tracks.SERIES]
        print(",".join([r["path"], str(r["abs_pos"]), *series] if a.expand else series))
    print()


def summarise(spark: SparkSession, path: str) -> DataFrame:
    """Length summaries of an assembly file."""
    asm = sequences.read_sequences(spark, path)
    return assembly.assembly_summary(windows.segments(asm), windows.components(asm))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    try:
        {"validate": validate, "union": union, "subgraph": extract, "inflate": inflate, "lookup": lookup}[a.mode](spark, a)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
