"""Registered queries on the shared tables, each with its SQL where SQL can express it.

Reads are the ``documents``, the assembly is ``benchmark``; letters become bases by a fixed table. The queries
that search the graph take letters alone, so a passage is one contig, and an assembly with a substituted base
every ``STEP`` bases, so that there are walks and variants to find. ``edge_missing`` takes reads cut into pieces of k bases, which support no edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import bases
from helixframe.operators import assembly, evaluate, graph, subgraph, tracks, unitigs, variants
from helixframe.operators import windows as cut
from helixframe.scratch import materialise, new_path
from helixframe.sources import binary_track, database, sequences
from helixframe.streaming.ingest import ingest

K = 21
FIRST, STEP = 30, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bases.text_as_bases(F.col("text")).alias("sequence"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("header"), bases.text_as_bases(F.col("text")).alias("sequence"))


def letter_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bases.letters_as_bases(F.col("text")).alias("sequence"))


def changed_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages with a substituted base every ``STEP`` bases."""
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("header"), bases.letters_as_bases(F.col("text")).alias("sequence"))
    return own.select("header", bases.substituted(F.col("sequence"), FIRST, STEP).alias("sequence"))


def _dbg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(reads(spark, sf_dir), K)


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the graph that the assembly's own k-mers need."""
    return graph.build(reads(spark, sf_dir), K, only=graph.assembly_keys(contigs(spark, sf_dir), K))


def _track(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return evaluate.track(contigs(spark, sf_dir), _known(spark, sf_dir), K, whole=whole)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.cast("string").alias("header"), (F.lit(3) + i % 7).alias("begin"), (F.lit(30) + i % 11).alias("end"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def kmer_count(s: SparkSession, d: str) -> DataFrame:
    return _dbg(s, d)


def kmer_histogram(s: SparkSession, d: str) -> DataFrame:
    return graph.histogram(_dbg(s, d))


def db_stats(s: SparkSession, d: str) -> DataFrame:
    return graph.stats(_dbg(s, d), K)


def node_degrees(s: SparkSession, d: str) -> DataFrame:
    bits = bases.edge_bits([F.col(c) for c in graph.FORWARD], [F.col(c) for c in graph.BACKWARD])
    return _dbg(s, d).select(graph.forward_count().alias("forward"), graph.backward_count().alias("backward"), bits.alias("edge_bits")).groupBy("forward", "backward", "edge_bits").agg(F.count("*").alias("n_kmers"))


def saturating_union(s: SparkSession, d: str) -> DataFrame:
    own = reads(s, d)
    return graph.merge([graph.build(own.where(F.pmod("doc_id", F.lit(2)) == i), K) for i in (0, 1)])


def database_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "database")
    database.save(_dbg(s, d), path, K)
    found, k = database.load(s, path)
    return graph.stats(found, k)


def streaming_ingest(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "documents").schema
    source = s.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    return graph.stats(ingest(source.select(bases.text_as_bases(F.col("text")).alias("sequence")), new_path(s, "stream"), K), K)


def validate_qv(s: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.scores(_track(s, d), K), "qv", "error")


def validate_by_segment(s: SparkSession, d: str) -> DataFrame:
    return evaluate.totals(_track(s, d), by=("path", "segment_id"))


def coverage_cutoff(s: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.scores(_track(s, d), K, cutoff=3), "qv", "error")


def edge_missing(s: SparkSession, d: str) -> DataFrame:
    own = reads(s, d)
    pieces = own.select(F.regexp_replace("sequence", f"(.{{{K}}})", "$1N").alias("sequence"))
    rows = evaluate.track(contigs(s, d), graph.build(pieces, K, only=graph.assembly_keys(contigs(s, d), K)), K)
    return rows.where(evaluate.is_edge_missing()).select("path", "abs_pos", "cov")


def base_track(s: SparkSession, d: str) -> DataFrame:
    return _track(s, d, whole=True).select("path", "segment_id", "pos", "abs_pos", "cov", "right", "left")


def anomalies(s: SparkSession, d: str) -> DataFrame:
    return evaluate.anomalies(_track(s, d), K)


def support_ahead(s: SparkSession, d: str) -> DataFrame:
    return evaluate.support_ahead(_track(s, d), K).select("path", "abs_pos", "score")


def kmer_track_window(s: SparkSession, d: str) -> DataFrame:
    lines = tracks.table_lines(_track(s, d, whole=True), "bed", K)
    return lines.select("path", "abs_pos", "line")


def step_track(s: SparkSession, d: str) -> DataFrame:
    return tracks.step_lines(_track(s, d, whole=True)).select("path", "abs_pos", "part", "line")


def range_lookup(s: SparkSession, d: str) -> DataFrame:
    return tracks.lookup(_track(s, d, whole=True), _intervals(s, d), span=2).select("path", "begin", "end", "abs_pos", "cov", "right", "left")


def bed_window_filter(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.track(contigs(s, d), _known(s, d), K, intervals=_intervals(s, d))
    return rows.select("path", "abs_pos", "cov")


def interval_projection(s: SparkSession, d: str) -> DataFrame:
    return tracks.project_intervals(cut.components(contigs(s, d)), _intervals(s, d))


def path_offsets(s: SparkSession, d: str) -> DataFrame:
    return cut.components(contigs(s, d)).select("path", "kind", "abs_start", "length")


def n_split_segments(s: SparkSession, d: str) -> DataFrame:
    return cut.segments(contigs(s, d)).select("path", "segment_id", "abs_start", "seq", "length")


def assembly_lengths(s: SparkSession, d: str) -> DataFrame:
    own = contigs(s, d)
    return _rounded(assembly.assembly_summary(cut.segments(own), cut.components(own)), "average", "aun")


def base_composition(s: SparkSession, d: str) -> DataFrame:
    return _rounded(assembly.composition(cut.segments(contigs(s, d)), by=("path",)), "gc_percent")


def fasta_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "fasta")
    contigs(s, d).select(F.concat(F.lit(">"), "header", F.lit(" item\n"), "sequence").alias("value")).write.text(path, compression="gzip")
    return sequences.read_fasta(s, path).select("header", "comment", "sequence")


def fastq_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "fastq")
    record = F.concat(F.lit("@"), "header", F.lit(" item\n"), "sequence", F.lit("\n+\n"), F.expr("repeat('!', length(sequence))"))
    contigs(s, d).select(record.alias("value")).write.text(path)
    return sequences.read_fastq(s, path).select("header", "comment", "sequence", "quality")


def _graph_file(s: SparkSession, d: str, version: int) -> DataFrame:
    """Every passage as a segment, and a path over it in both directions, written and read as an assembly."""
    path = new_path(s, "gfa")
    size = [F.length("sequence").cast("string")] if version == 2 else []
    steps = F.concat("header", F.lit("+ " if version == 2 else "+,"), "header", F.lit("-"))
    rows = F.array(F.concat_ws("\t", F.lit("S"), "header", *size, "sequence"), F.concat_ws("\t", F.lit("O" if version == 2 else "P"), F.concat(F.lit("p"), "header"), steps))
    contigs(s, d).select(F.explode(rows).alias("value")).write.text(path)
    return sequences.read_assembly(s, path).select("path", "segment_id", "abs_start", "seq", "length")


def gfa_assembly(s: SparkSession, d: str) -> DataFrame:
    return _graph_file(s, d, 1)


def gfa2_assembly(s: SparkSession, d: str) -> DataFrame:
    return _graph_file(s, d, 2)


def bed_positions(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "bed")
    _intervals(s, d).select(F.concat_ws("\t", "header", F.col("begin").cast("string"), F.col("end").cast("string")).alias("value")).write.text(path)
    return tracks.expand_intervals(sequences.read_bed(s, path))


def coordinate_lookup(s: SparkSession, d: str) -> DataFrame:
    found = tracks.lookup(_track(s, d, whole=True), sequences.parse_coordinate(s, "22:2-40"))
    return found.select("path", "begin", "end", "abs_pos", "cov", "right", "left")


def _binary_track(s: SparkSession, d: str) -> DataFrame:
    """The track as one binary file, which the driver writes to a folder it can open, read back.

    The file numbers the segments that it holds: those without a window are not in it.
    """
    path = new_path(s, "binary-track")
    binary_track.write_binary_track(materialise(_track(s, d, whole=True), "track"), path.removeprefix("file://"), K)
    return binary_track.read_binary_track(s, path)


def binary_track_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return _binary_track(s, d)


def inflate_track(s: SparkSession, d: str) -> DataFrame:
    return tracks.step_lines(_binary_track(s, d)).select("path", "abs_pos", "part", "line")


def csv_track(s: SparkSession, d: str) -> DataFrame:
    return tracks.table_lines(_track(s, d, whole=True), "csv", K).select("path", "abs_pos", "line")


def csv_table_track(s: SparkSession, d: str) -> DataFrame:
    return tracks.table_lines(_track(s, d, whole=True), "csvtable", K).select("path", "abs_pos", "line")


def base_codes(s: SparkSession, d: str) -> DataFrame:
    own = contigs(s, d).select("header", F.lower(F.left("sequence", F.lit(1))).alias("base"))
    return own.select("header", "base", bases.encode_base(F.col("base")).alias("code"), bases.decode_base(bases.encode_base(F.col("base"))).alias("decoded"))


def kmer_lookup(s: SparkSession, d: str) -> DataFrame:
    """The node of the first key, asked for by its other strand in lower case."""
    dbg = materialise(_dbg(s, d), "dbg")
    kmer = dbg.select(F.lower(bases.reverse_complement(F.min("key"))).alias("kmer")).first()["kmer"]
    return evaluate.lookup_kmer(dbg, kmer)


def colour_names(s: SparkSession, d: str) -> DataFrame:
    return subgraph_seeds(s, d).groupBy(bases.colour_name(F.col("colour")).alias("colour")).agg(F.count("*").alias("n_kmers"))


def prune_above_cutoff(s: SparkSession, d: str) -> DataFrame:
    return subgraph.prune_edges(materialise(subgraph_seeds(s, d), "seeds"), cutoff=2)


def vcf_file(s: SparkSession, d: str) -> DataFrame:
    return variants.vcf_lines(variant_calls(s, d)).select("part", "line")


def subgraph_seeds(s: SparkSession, d: str) -> DataFrame:
    return subgraph.seeds(contigs(s, d), _known(s, d), K)


def subgraph_summary(s: SparkSession, d: str) -> DataFrame:
    return subgraph.summary(prune_edges(s, d), K)


def prune_edges(s: SparkSession, d: str) -> DataFrame:
    return subgraph.prune_edges(materialise(subgraph.seeds(contigs(s, d), _known(s, d), K), "seeds"))


def export_edges(s: SparkSession, d: str) -> DataFrame:
    return unitigs.node_graph(prune_edges(s, d))[1]


def traversal_depth_2(s: SparkSession, d: str) -> DataFrame:
    dbg = materialise(graph.build(reads(s, d), K, near=graph.around(graph.assembly_keys(contigs(s, d), K), K, within=2)), "dbg")
    return subgraph.traversal(subgraph.seeds(contigs(s, d), dbg, K), dbg, 2)


def _searched(s: SparkSession, d: str) -> DataFrame:
    """The part of the graph that a search from the changed passages and back to them can use."""
    return subgraph.corridor(changed_contigs(s, d), letter_reads(s, d), K)


def _extracted(s: SparkSession, d: str) -> DataFrame:
    return subgraph.extract(changed_contigs(s, d), _searched(s, d), K)


def best_first(s: SparkSession, d: str) -> DataFrame:
    return _extracted(s, d)


def unitig_segments(s: SparkSession, d: str) -> DataFrame:
    return unitigs.unitigs(_extracted(s, d))[0]


def unitig_edges(s: SparkSession, d: str) -> DataFrame:
    return unitigs.unitigs(_extracted(s, d))[1]


def unitig_summary(s: SparkSession, d: str) -> DataFrame:
    return unitigs.graph_summary(*unitigs.unitigs(_extracted(s, d)))


def graph_export(s: SparkSession, d: str) -> DataFrame:
    return unitigs.gfa_lines(*unitigs.unitigs(_extracted(s, d)), K)


def _variants(s: SparkSession, d: str) -> DataFrame:
    return variants.variants(changed_contigs(s, d), _searched(s, d), K)


def variant_calls(s: SparkSession, d: str) -> DataFrame:
    return variants.vcf_rows(_variants(s, d), changed_contigs(s, d))


def variant_graph(s: SparkSession, d: str) -> DataFrame:
    return variants.variant_graph(_variants(s, d), changed_contigs(s, d))[1]


_NAMES = (
    "kmer_count kmer_histogram db_stats node_degrees saturating_union database_roundtrip streaming_ingest validate_qv validate_by_segment coverage_cutoff edge_missing base_track anomalies "
    "support_ahead kmer_track_window step_track range_lookup bed_window_filter interval_projection path_offsets n_split_segments assembly_lengths base_composition fasta_roundtrip subgraph_seeds "
    "subgraph_summary prune_edges export_edges traversal_depth_2 best_first unitig_segments unitig_edges unitig_summary graph_export variant_calls variant_graph "
    "fastq_roundtrip gfa_assembly gfa2_assembly bed_positions coordinate_lookup binary_track_roundtrip inflate_track csv_track csv_table_track base_codes kmer_lookup colour_names prune_above_cutoff vcf_file"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES}

_ENC = f"translate(regexp_replace(replace(text, ' ', ''), '[^A-Za-z]', '#', 'g'), '{bases.LETTERS}#', '{bases.LETTER_BASES}N')"


def _c(base: str) -> str:
    return f"translate({base}, 'ACGT', 'TGCA')"


def _counts(where: str = "true", encoding: str = _ENC, pieces: bool = False) -> str:
    """CTEs up to a graph of the documents that ``where`` selects; ``pieces``: of their pieces of k characters."""
    whole = f"SELECT {encoding} AS e FROM documents WHERE {where}"
    if pieces:
        whole = f"SELECT unnest(list_transform(generate_series(0, length(e) - 1, {K}), lambda i: substr(e, i + 1, {K}))) AS e FROM ({whole}) WHERE length(e) > 0"
    f, b = f"CASE WHEN kmer <= rc THEN r ELSE {_c('l')} END", f"CASE WHEN kmer <= rc THEN l ELSE {_c('r')} END"
    sums = ", ".join(f"count(*) FILTER (({e}) = '{x}') AS {n}{i}" for n, e in (("fw", f), ("bw", b)) for i, x in enumerate("ACGT"))
    return f"""frag AS (SELECT unnest(string_split_regex(e, 'N+')) AS s FROM ({whole})),
    place AS (SELECT s, unnest(generate_series(1, length(s) - {K} + 1)) AS p FROM frag WHERE length(s) >= {K}),
    win AS (SELECT substr(s, p, {K}) AS kmer, reverse({_c(f'substr(s, p, {K})')}) AS rc, CASE WHEN p > 1 THEN substr(s, p - 1, 1) END AS l, nullif(substr(s, p + {K}, 1), '') AS r FROM place),
    dbg AS MATERIALIZED (SELECT least(kmer, rc) AS key, count(*) AS cov, {sums} FROM win GROUP BY 1)"""


_LETTERS = f"translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{bases.LETTERS}', '{bases.LETTER_BASES}')"
_CHANGED = f"""substr(e, 1, {FIRST}) || array_to_string(list_transform(generate_series({FIRST}, length(e) - 1, {STEP}), lambda i: translate(substr(e, i + 1, 1), 'ACGT', 'CGTA') || substr(e, i + 2, {STEP - 1})), '')"""


def _runs(encoded: str) -> str:
    """CTE ``segs``: the segments of the assembly ``encoded`` (path, e)."""
    return f"""runs AS (SELECT path, i, run, coalesce(sum(length(run) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS abs_start
      FROM (SELECT path, generate_subscripts(x, 1) AS i, unnest(x) AS run FROM (SELECT path, string_split(e, 'N') AS x FROM ({encoded})))),
    segs AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS segment_id, abs_start, run AS seq, length(run)::BIGINT AS length FROM runs WHERE length(run) > 0)"""


_RUNS = _runs(f"SELECT item_id::VARCHAR AS path, {_ENC} AS e FROM benchmark")
_CHANGED_RUNS = _runs(f"SELECT path, {_CHANGED} AS e FROM (SELECT item_id::VARCHAR AS path, {_LETTERS} AS e FROM benchmark)")
_EDGE = {
    "right": [f"WHEN kmer <= rc AND r = '{x}' THEN fw{i}" for i, x in enumerate("ACGT")] + [f"WHEN kmer > rc AND r = '{x}' THEN bw{3 - i}" for i, x in enumerate("ACGT")],
    "left": [f"WHEN kmer <= rc AND l = '{x}' THEN bw{i}" for i, x in enumerate("ACGT")] + [f"WHEN kmer > rc AND l = '{x}' THEN fw{3 - i}" for i, x in enumerate("ACGT")],
}


def _trk(whole: bool = False, pieces: bool = False) -> str:
    """CTEs up to the track ``t`` of the assembly."""
    last = "length" if whole else f"length - {K} + 1"
    return f"""{_counts(pieces=pieces)}, {_RUNS},
    spots AS (SELECT *, unnest(generate_series(1, {last})) AS p FROM segs WHERE length >= {K}),
    awin AS (SELECT path, segment_id, abs_start, (p - 1)::BIGINT AS pos, (abs_start + p - 1)::BIGINT AS abs_pos, length - {K} + 1 AS kcount, CASE WHEN p <= length - {K} + 1 THEN substr(seq, p, {K}) END AS kmer,
      CASE WHEN p > 1 THEN substr(seq, p - 1, 1) END AS l, nullif(substr(seq, p + {K}, 1), '') AS r FROM spots),
    aw AS (SELECT *, reverse({_c('kmer')}) AS rc FROM awin),
    t AS (SELECT path, segment_id, pos, abs_pos, kcount, coalesce(cov, 0) AS cov, coalesce(CASE {' '.join(_EDGE['right'])} ELSE 0 END, 0) AS "right", coalesce(CASE {' '.join(_EDGE['left'])} ELSE 0 END, 0) AS "left"
      FROM aw LEFT JOIN dbg ON dbg.key = least(aw.kmer, aw.rc))"""


_EDGE_SUM = " + ".join(f"(fw{i} > 0 OR bw{i} > 0)::INT" for i in range(4))
_SLOT_SUM = " + ".join(f"({c} > 0)::INT" for c in graph.EDGES)
_STATS = f"""SELECT sum(cov)::BIGINT AS total, count(*) FILTER (cov = 1) AS "unique", count(*) AS "distinct", {4**K} - count(*) AS missing, sum({_EDGE_SUM})::BIGINT AS edges, sum({_SLOT_SUM})::BIGINT AS edge_slots FROM dbg"""


def _qv(cutoff: int) -> str:
    lost = f"(cov = 0 OR cov < {cutoff})"
    edge = f'NOT {lost} AND pos > 0 AND pos < kcount - 1 AND "left" = 0 AND "right" = 0'
    return f"""WITH {_trk()}, n AS (SELECT count(*) AS total, count(*) FILTER ({lost}) AS missing, count(*) FILTER ({edge}) AS e FROM t),
    m AS (SELECT missing, total, 'kmer' AS method FROM n UNION ALL SELECT missing + e, total, 'edge' FROM n),
    x AS (SELECT *, 1 - pow(1 - missing::DOUBLE / total, 1.0 / {K}) AS err FROM m)
    SELECT missing, total, round(CASE WHEN err <= 0 THEN 'inf'::DOUBLE ELSE -10 * log10(err) + 0.0 END, 6) AS qv, round(err, 6) AS error, {K} AS k, method FROM x"""




def _table_lines(column: str, entry: str) -> str:
    """Lines of the windowed track with the given separators."""
    own = ", ".join(f"repeat('0{entry}', {K} - len({c}_w)) || array_to_string({c}_w, '{entry}') AS {c}_s" for c in ("cov", "right", "left"))
    return f"""WITH {_trk(True)}, w AS (SELECT path, abs_pos, list(cov) {_FRAME} AS cov_w, list("right") {_FRAME} AS right_w, list("left") {_FRAME} AS left_w FROM t),
      x AS (SELECT path, abs_pos, {own} FROM w) SELECT path, abs_pos, concat_ws({column}, path, abs_pos, cov_s, right_s, left_s) AS line FROM x"""


_FRAME = f"OVER (PARTITION BY path, segment_id ORDER BY pos ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW)"
_IV = "iv AS (SELECT item_id::VARCHAR AS header, 3 + item_id % 7 AS \"begin\", 30 + item_id % 11 AS \"end\" FROM benchmark)"
_SUMMARY = """SELECT '{kind}' AS kind, count(*) AS n, coalesce(sum(length), 0)::BIGINT AS total, round(sum(length)::DOUBLE / count(*), 6) AS average,
  coalesce((SELECT length FROM (SELECT length, sum(length) OVER (ORDER BY length DESC, id) AS c, sum(length) OVER () AS w FROM {t}) WHERE c >= w / 2.0 ORDER BY c LIMIT 1), 0) AS n50,
  coalesce((SELECT count(*) FILTER (c - length < w / 2.0) FROM (SELECT length, sum(length) OVER (ORDER BY length DESC, id) AS c, sum(length) OVER () AS w FROM {t})), 0) AS l50,
  coalesce(round(sum(length * length)::DOUBLE / sum(length), 6), 0.0) AS aun, coalesce(max(length), 0) AS largest, coalesce(min(length), 0) AS smallest FROM {t}"""
_GAPS = f"""comps AS (SELECT path, kind, min(spot) AS abs_start, count(*)::BIGINT AS length FROM (
      SELECT path, spot, kind, spot - row_number() OVER (PARTITION BY path, kind ORDER BY spot) AS g FROM (
        SELECT path, spot, CASE WHEN substr(e, spot + 1, 1) = 'N' THEN 'GAP' ELSE 'SEGMENT' END AS kind FROM (
          SELECT path, e, unnest(generate_series(0, length(e) - 1)) AS spot FROM (SELECT item_id::VARCHAR AS path, {_ENC} AS e FROM benchmark))))
    GROUP BY path, kind, g)"""
def _seeds(before: str) -> str:
    """CTEs up to the nodes ``seeds`` of the assembly, after those of ``segs`` and ``dbg``."""
    return f"""{before},
    spots AS (SELECT *, unnest(generate_series(1, length - {K} + 1)) AS p FROM segs WHERE length >= {K}),
    aw AS (SELECT path, segment_id, p, substr(seq, p, {K}) AS kmer, reverse({_c(f'substr(seq, p, {K})')}) AS rc, CASE WHEN p > 1 THEN substr(seq, p - 1, 1) END AS l, nullif(substr(seq, p + {K}, 1), '') AS r FROM spots),
    firsts AS (SELECT path, segment_id, least(kmer, rc) AS key, arg_min(coalesce(CASE WHEN kmer <= rc THEN r ELSE {_c('l')} END, '-'), p) AS f, arg_min(coalesce(CASE WHEN kmer <= rc THEN l ELSE {_c('r')} END, '-'), p) AS b FROM aw GROUP BY ALL),
    seeds AS MATERIALIZED (SELECT firsts.key, sum(coalesce(cov, 1))::BIGINT AS cov, {', '.join(f"sum(CASE WHEN cov IS NULL THEN ({x} = '{y}')::INT ELSE {n}{i} END)::BIGINT AS {n}{i}" for n, x in (('fw', 'f'), ('bw', 'b')) for i, y in enumerate('ACGT'))},
      max(CASE WHEN cov IS NULL THEN 2 ELSE 1 END)::INT AS colour FROM firsts LEFT JOIN dbg USING (key) GROUP BY firsts.key)"""


_SEEDS = _seeds(f"{_counts()}, {_RUNS}")
_NEAR = _seeds(f"{_counts(encoding=_LETTERS)}, {_CHANGED_RUNS}")


def _nexts(source: str, cutoff: int = 0) -> str:
    """(key, edge, weight, next, next_key) of every edge of ``source`` above the cutoff."""
    parts = []
    for i, x in enumerate("ACGT"):
        for c, n in ((f"fw{i}", f"substr(key, 2) || '{x}'"), (f"bw{i}", f"'{x}' || substr(key, 1, {K - 1})")):
            parts.append(f"SELECT key, '{c}' AS edge, {c} AS weight, {n} AS nx, least({n}, reverse({_c(n)})) AS next_key FROM {source} WHERE {c} > {cutoff}")
    return " UNION ALL ".join(parts)


def _pruned(nodes: str, cutoff: int = 0) -> str:
    """CTEs up to ``pruned``: ``nodes`` without edges to absent nodes."""
    return f"""steps AS ({_nexts(nodes, cutoff)}), there AS (SELECT * FROM steps WHERE next_key IN (SELECT key FROM {nodes})),
    sums AS (SELECT key, {', '.join(f"max(weight) FILTER (edge = '{c}') AS {c}" for c in graph.EDGES)} FROM there GROUP BY key),
    pruned AS MATERIALIZED (SELECT s.key, s.cov, {', '.join(f"coalesce(u.{c}, 0) AS {c}" for c in graph.EDGES)}, s.colour FROM {nodes} s LEFT JOIN sums u ON s.key = u.key)"""


def _rc(kmer: str) -> str:
    return f"reverse({_c(kmer)})"


def _onward(oriented: str = "o") -> str:
    """Rows of (base, count) by which an oriented k-mer of node ``key`` goes on."""
    options = ", ".join(f"{{'base': '{x}', 'n': CASE WHEN {oriented} = key THEN fw{i} ELSE bw{3 - i} END}}" for i, x in enumerate("ACGT"))
    return f"unnest(list_filter([{options}], lambda x: x.n > 0))"


_PRUNED = f"{_SEEDS}, {_pruned('seeds')}"
_COUNTS = ", ".join(graph.COUNTS)
# walks of new nodes that leave a seed, by hops; those that come back are the reverse complements of others
_FOUND = f"""{_NEAR}, leaving AS (SELECT DISTINCT substr(o, 2) || s.base AS o FROM (SELECT o, {_onward()} AS s FROM (SELECT *, unnest([key, {_rc('key')}]) AS o FROM seeds))),
    walk AS (SELECT l.o, d.key, 1 AS hop FROM leaving l JOIN dbg d ON d.key = least(l.o, {_rc('l.o')}) ANTI JOIN seeds ON seeds.key = d.key
      UNION SELECT n.o, d.key, n.hop FROM (SELECT substr(o, 2) || s.base AS o, hop + 1 AS hop FROM (SELECT w.o, w.hop, {_onward('w.o').replace('= key', '= g.key').replace('fw', 'g.fw').replace('bw', 'g.bw')} AS s FROM walk w JOIN dbg g ON g.key = w.key WHERE w.hop < {K})) n
      JOIN dbg d ON d.key = least(n.o, {_rc('n.o')}) ANTI JOIN seeds ON seeds.key = d.key),
    seen AS MATERIALIZED (SELECT o, key, min(hop) AS hop FROM walk GROUP BY ALL),
    nodes AS MATERIALIZED (SELECT key, {_COUNTS}, colour FROM seeds UNION ALL SELECT key, {_COUNTS}, 0 FROM dbg
      WHERE key IN (SELECT s.key FROM seen s JOIN seen b ON s.o = {_rc('b.o')} WHERE s.hop + b.hop - 1 <= {K})),
    {_pruned('nodes')}"""
_FLIP = "CASE WHEN {} = '+' THEN '-' ELSE '+' END"
_UNITIGS = f"""{_FOUND}, strands AS MATERIALIZED (SELECT *, unnest([key, {_rc('key')}]) AS o FROM pruned),
    known AS (SELECT o AS a, substr(o, 2) || s.base AS b, s.n AS count FROM (SELECT o, {_onward()} AS s FROM strands)),
    links AS MATERIALIZED (SELECT a, b, max(count) AS count FROM (SELECT * FROM known UNION ALL SELECT {_rc('b')}, {_rc('a')}, count FROM known) GROUP BY a, b),
    inward AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT a, any_value(b) AS b FROM links GROUP BY a HAVING count(*) = 1) x JOIN (SELECT b FROM links GROUP BY b HAVING count(*) = 1) y ON x.b = y.b WHERE x.b <> {_rc('x.a')}),
    path AS (SELECT o AS head, o AS node, 0 AS nth FROM strands ANTI JOIN inward ON inward.b = strands.o UNION ALL SELECT head, b, nth + 1 FROM path JOIN inward ON inward.a = path.node),
    joined AS (SELECT head, arg_max(node, nth) AS tail, count(*) AS n_kmers, avg(cov) AS depth, max(colour) AS colour, head || coalesce(string_agg(right(node, 1), '' ORDER BY nth) FILTER (nth > 0), '') AS sequence
      FROM path JOIN strands ON strands.o = path.node GROUP BY head),
    paths AS MATERIALIZED (SELECT *, least(sequence, {_rc('sequence')}) AS name, CASE WHEN sequence <= {_rc('sequence')} THEN '+' ELSE '-' END AS strand FROM joined),
    segments AS (SELECT name, sequence, n_kmers, round(depth, 6) AS depth, CASE colour WHEN 0 THEN 'gray' WHEN 1 THEN 'blue' ELSE 'red' END AS colour FROM paths WHERE strand = '+'),
    between_ AS (SELECT e.name AS s, e.strand AS x, f.name AS t, f.strand AS y, count FROM links JOIN paths e ON links.a = e.tail JOIN paths f ON links.b = f.head),
    turned AS (SELECT *, {_FLIP.format('y')} AS tx, {_FLIP.format('x')} AS ty FROM between_),
    canon AS (SELECT CASE WHEN (s, x, t, y) <= (t, tx, s, ty) THEN {{'s': s, 'x': x, 't': t, 'y': y}} ELSE {{'s': t, 'x': tx, 't': s, 'y': ty}} END AS e, count FROM turned),
    ends AS MATERIALIZED (SELECT e.s AS source, e.x AS source_strand, e.t AS target, e.y AS target_strand, max(count) AS count FROM canon GROUP BY ALL)"""
_SIDES = f"""{_UNITIGS}, one AS (SELECT source AS name, CASE WHEN source_strand = '+' THEN 'R' ELSE 'L' END AS side, target AS other, CASE WHEN target_strand = '+' THEN 'L' ELSE 'R' END AS other_side FROM ends),
    sides AS MATERIALIZED (SELECT * FROM one UNION SELECT other, other_side, name, side FROM one),
    reach AS (SELECT name, name AS other FROM segments UNION SELECT r.name, s.other FROM reach r JOIN sides s ON s.name = r.other),
    parts AS (SELECT min_name, sum(length(name)) AS size FROM (SELECT name, min(other) AS min_name FROM reach GROUP BY name) GROUP BY min_name),
    degree AS (SELECT name, side, count(*) AS n FROM sides GROUP BY ALL),
    single AS (SELECT name FROM degree WHERE n = 1 GROUP BY name HAVING count(*) = 2),
    arms AS (SELECT least(l.other || chr(1) || l.other_side, r.other || chr(1) || r.other_side) AS a, greatest(l.other || chr(1) || l.other_side, r.other || chr(1) || r.other_side) AS b
      FROM sides l JOIN sides r ON l.name = r.name AND l.side = 'L' AND r.side = 'R' WHERE l.name IN (SELECT name FROM single)),
    forks AS (SELECT a, b FROM arms WHERE a <> b GROUP BY a, b HAVING count(*) >= 2),
    across AS (SELECT name || chr(1) || CASE WHEN side = 'R' THEN 'L' ELSE 'R' END AS z FROM degree),
    sizes AS (SELECT count(*) AS segments, sum(length(sequence))::BIGINT AS total_length FROM segments),
    lines AS (SELECT count(*) AS edges, count(*) FILTER (source = target AND source_strand = target_strand) AS circular FROM ends)"""
# alternate walks of an assembly window: (hop, bases) orders those that reach one k-mer; a walk ends where it meets the assembly again
_SPOT = "path, segment_id, pos"
_WALKS = f"""{_counts(encoding=_LETTERS)}, {_CHANGED_RUNS},
    spots AS (SELECT *, unnest(generate_series(0, length - {K})) AS pos FROM segs WHERE length >= {K}),
    ref AS MATERIALIZED (SELECT path, segment_id, abs_start, pos, seq, length - {K} + 1 AS kcount, substr(seq, pos + 1, {K}) AS o, least(substr(seq, pos + 1, {K}), {_rc(f'substr(seq, pos + 1, {K})')}) AS key FROM spots),
    start AS (SELECT r.{_SPOT.replace(', ', ', r.')}, r.abs_start, r.o, r.key AS own, nxt.key AS ref_key FROM ref r JOIN ref nxt ON nxt.path = r.path AND nxt.segment_id = r.segment_id AND nxt.pos = r.pos + 1 WHERE r.pos + {K} + 1 < r.kcount),
    stepped AS (SELECT {_SPOT}, abs_start, own, ref_key, substr(o, 2) || s.base AS o, s.base AS bases FROM (SELECT start.*, {_onward()} AS s FROM start JOIN dbg ON dbg.key = start.own)),
    walk AS (SELECT z.*, 1 AS hop, t.pos AS t_pos FROM (SELECT *, least(o, {_rc('o')}) AS next_key FROM stepped) z
        LEFT JOIN ref t ON t.path = z.path AND t.segment_id = z.segment_id AND t.key = z.next_key AND t.pos > z.pos + {K} AND t.pos <= z.pos + {K + 5} WHERE next_key <> ref_key AND next_key <> own
      UNION SELECT z.*, t.pos FROM (SELECT {_SPOT}, abs_start, own, ref_key, substr(o, 2) || s.base AS o, bases || s.base AS bases, least(substr(o, 2) || s.base, {_rc('(substr(o, 2) || s.base)')}) AS next_key, hop
        FROM (SELECT w.{_SPOT.replace(', ', ', w.')}, w.abs_start, w.own, w.ref_key, w.o, w.bases, w.hop + 1 AS hop, {_onward('w.o')} AS s FROM walk w JOIN dbg ON dbg.key = w.next_key WHERE w.t_pos IS NULL AND w.hop < {K + 1})) z
        LEFT JOIN ref t ON t.path = z.path AND t.segment_id = z.segment_id AND t.key = z.next_key AND t.pos > z.pos + {K} AND t.pos <= z.pos + {K + 5} WHERE next_key <> ref_key AND next_key <> own),
    firsts AS (SELECT {_SPOT}, abs_start, next_key, min((hop, bases)) AS m FROM walk GROUP BY ALL),
    hits AS (SELECT w.{_SPOT.replace(', ', ', w.')}, w.abs_start, w.bases, min(w.t_pos) AS t_pos FROM walk w JOIN firsts f ON w.path = f.path AND w.segment_id = f.segment_id AND w.pos = f.pos AND w.next_key = f.next_key AND (w.hop, w.bases) = f.m
      WHERE w.t_pos IS NOT NULL GROUP BY w.{_SPOT.replace(', ', ', w.')}, w.abs_start, w.bases, w.next_key),
    shaped AS (SELECT h.*, (h.t_pos - h.pos - {K} - 1)::INT AS t, length(h.bases) - 1 AS inner_, ref.o || h.bases AS whole, ref.seq FROM hits h JOIN ref ON ref.path = h.path AND ref.segment_id = h.segment_id AND ref.pos = h.pos),
    calls AS MATERIALIZED (SELECT path, segment_id, (pos + {K})::BIGINT AS pos, abs_start, seq, CASE WHEN t > 0 THEN 'COM' WHEN inner_ = {K} THEN 'SNV' WHEN inner_ > {K} THEN 'DEL' ELSE 'INS' END AS type, CASE WHEN t > 0 THEN t + 1 ELSE 1 END AS ref_len,
      CASE WHEN t > 0 THEN substr(whole, inner_ - t + 1, t + 1) WHEN inner_ = {K} THEN left(bases, 1) WHEN inner_ > {K} THEN left(bases, inner_ - {K}) ELSE '' END AS alt FROM shaped)"""
_CALLS = """SELECT path AS chrom, abs_start + pos + CASE WHEN type IN ('INS', 'DEL') THEN 0 ELSE 1 END AS pos, CASE WHEN type IN ('INS', 'DEL') THEN substr(seq, pos, 2) ELSE substr(seq, pos + 1, ref_len) END AS ref,
      CASE type WHEN 'INS' THEN substr(seq, pos, 1) WHEN 'DEL' THEN substr(seq, pos, 1) || alt || substr(seq, pos + 1, 1) ELSE alt END AS alt, type FROM calls"""
_GRAPHED = f"""{_WALKS}, sites AS (SELECT DISTINCT path, segment_id, pos AS start, pos + CASE WHEN type = 'DEL' THEN 0 ELSE ref_len END AS stop, alt FROM calls),
    apart AS (SELECT *, max(stop) OVER (PARTITION BY path, segment_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT path, segment_id, start, stop FROM sites)),
    spans AS (SELECT *, row_number() OVER (PARTITION BY path, segment_id ORDER BY start, stop) - 1 AS site, path || '.' || segment_id AS name FROM apart WHERE before IS NULL OR start >= before),
    alts AS (SELECT spans.name, site, alt, row_number() OVER (PARTITION BY spans.path, spans.segment_id, site ORDER BY alt) AS a FROM spans JOIN sites USING (path, segment_id, start, stop)),
    middle AS (SELECT name, site, CASE WHEN stop > start THEN name || '.r.' || site END AS m FROM spans UNION ALL SELECT name, site, CASE WHEN alt <> '' THEN name || '.a.' || site || '.' || a END FROM alts),
    joins AS (SELECT name || '.p.' || site AS u, m, name || '.p.' || (site + 1) AS w FROM middle)"""
_BOTH_WAYS = f"""WITH e AS (SELECT item_id::VARCHAR AS id, {_ENC} AS e FROM benchmark) SELECT 'p' || id AS path, 0::BIGINT AS segment_id, 0::BIGINT AS abs_start, e AS seq, length(e)::BIGINT AS length FROM e
  UNION ALL SELECT 'p' || id, 1, length(e), {_rc('e')}, length(e) FROM e"""
ORACLES: dict[str, str] = {
    "kmer_count": f"WITH {_counts()} SELECT * FROM dbg",
    "kmer_histogram": f"WITH {_counts()} SELECT cov, count(*) AS n_kmers FROM dbg GROUP BY cov",
    "db_stats": f"WITH {_counts()} {_STATS}",
    "database_roundtrip": f"WITH {_counts()} {_STATS}",
    "streaming_ingest": f"WITH {_counts()} {_STATS}",
    "node_degrees": f"""WITH {_counts()} SELECT {' + '.join(f'(fw{i} > 0)::INT' for i in range(4))} AS forward, {' + '.join(f'(bw{i} > 0)::INT' for i in range(4))} AS backward,
      {' + '.join(f'({c} > 0)::INT * {1 << (7 - i)}' for i, c in enumerate(graph.EDGES))} AS edge_bits, count(*) AS n_kmers FROM dbg GROUP BY ALL""",
    "saturating_union": f"""WITH a AS (WITH {_counts('doc_id % 2 = 0')} SELECT * FROM dbg), b AS (WITH {_counts('doc_id % 2 = 1')} SELECT * FROM dbg)
      SELECT key, {', '.join(f'least(sum({c}), 4294967295)::BIGINT AS {c}' for c in graph.COUNTS)} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY key""",
    "validate_qv": _qv(0),
    "coverage_cutoff": _qv(3),
    "validate_by_segment": f"""WITH {_trk()} SELECT path, segment_id, count(*) AS total, count(*) FILTER (cov = 0) AS missing, count(*) FILTER (cov > 0 AND pos > 0 AND pos < kcount - 1 AND "left" = 0 AND "right" = 0) AS edge_missing FROM t GROUP BY ALL""",
    "edge_missing": f"""WITH {_trk(pieces=True)} SELECT path, abs_pos, cov FROM t WHERE cov > 0 AND pos > 0 AND pos < kcount - 1 AND "left" = 0 AND "right" = 0""",
    "base_track": f"""WITH {_trk(True)} SELECT path, segment_id, pos, abs_pos, cov, "right", "left" FROM t""",
    "anomalies": f"""WITH {_trk()} SELECT path, segment_id, abs_pos + {K} AS position FROM t WHERE cov = 0 OR (pos < kcount - 1 AND "right" = 0)""",
    "support_ahead": f"""WITH {_trk()} SELECT path, abs_pos, coalesce(sum(CASE WHEN cov > 0 THEN 1 ELSE -1 END) OVER (PARTITION BY path, segment_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {K} FOLLOWING), 0)::BIGINT AS score FROM t""",
    "kmer_track_window": _table_lines("chr(9)", ":"),
    "csv_track": _table_lines("','", " "),
    "csv_table_track": _table_lines("','", ","),
    "step_track": f"""WITH {_trk(True)} SELECT path, abs_pos, 1 AS part, concat_ws(',', cov, "right", "left") AS line FROM t
      UNION ALL SELECT path, abs_pos, 0, 'fixedStep chrom=' || path || ' start=' || abs_pos || ' step=1' FROM t WHERE pos = 0""",
    "range_lookup": f"""WITH {_trk(True)}, {_IV}, bounds AS (SELECT path, segment_id, min(abs_pos) AS lo, max(abs_pos) + 1 AS hi FROM t GROUP BY ALL),
      w AS (SELECT iv.*, path, segment_id, greatest("begin" - 3, 0) AS first, least("end" + 1, hi) AS stop FROM iv JOIN bounds ON header = path AND greatest("begin" - 3, 0) >= lo AND greatest("begin" - 3, 0) < hi)
      SELECT t.path, "begin", "end", abs_pos, cov, "right", "left" FROM t JOIN w ON t.path = w.path AND t.segment_id = w.segment_id AND abs_pos >= first AND abs_pos < stop""",
    "bed_window_filter": f"""WITH {_trk()}, {_IV} SELECT path, abs_pos, cov FROM t WHERE EXISTS (SELECT 1 FROM iv WHERE header = path AND abs_pos >= "begin" AND abs_pos < "end")""",
    "interval_projection": f"""WITH {_GAPS}, {_IV}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY abs_start) - 1 AS comp_idx FROM comps)
      SELECT path, comp_idx::INT AS comp_idx, greatest("begin", abs_start) - abs_start AS "begin", least("end", abs_start + length) - abs_start AS "end" FROM iv JOIN o ON header = path AND "begin" < abs_start + length AND "end" > abs_start WHERE kind = 'SEGMENT'""",
    "path_offsets": f"WITH {_GAPS} SELECT path, kind, abs_start, length FROM comps",
    "n_split_segments": f"WITH {_RUNS} SELECT path, segment_id, abs_start, seq, length FROM segs",
    "assembly_lengths": f"""WITH {_RUNS}, {_GAPS}, sc AS (SELECT item_id AS id, length({_ENC}) AS length FROM benchmark), ct AS (SELECT path || '.' || segment_id AS id, length FROM segs), gp AS (SELECT path || '.' || abs_start AS id, length FROM comps WHERE kind = 'GAP')
      {_SUMMARY.format(kind='scaffolds', t='sc')} UNION ALL {_SUMMARY.format(kind='contigs', t='ct')} UNION ALL {_SUMMARY.format(kind='gaps', t='gp')}""",
    "base_composition": f"""WITH {_RUNS}, n AS (SELECT path, {', '.join(f"sum(length(seq) - length(replace(seq, '{x}', '')))::BIGINT AS {x.lower()}" for x in 'ACGT')}, 0::BIGINT AS soft_masked FROM segs GROUP BY path)
      SELECT *, round(CASE WHEN a + c + g + t > 0 THEN 100.0::DOUBLE * (c + g) / (a + c + g + t) END, 6) AS gc_percent FROM n""",
    "fasta_roundtrip": f"SELECT item_id::VARCHAR AS header, 'item' AS comment, {_ENC} AS sequence FROM benchmark",
    "subgraph_seeds": f"WITH {_SEEDS} SELECT key, {_COUNTS}, colour FROM seeds",
    "prune_edges": f"WITH {_PRUNED} SELECT * FROM pruned",
    "subgraph_summary": f"""WITH {_PRUNED} SELECT sum(cov)::BIGINT AS total, count(*) FILTER (cov = 1) AS "unique", count(*) AS "distinct", {4**K} - count(*) AS missing, sum({_EDGE_SUM})::BIGINT AS edges FROM pruned""",
    "export_edges": f"""WITH {_PRUNED}, e AS ({_nexts('pruned')}) SELECT key AS source, CASE WHEN edge LIKE 'fw%' THEN '+' ELSE '-' END AS source_strand, next_key AS target,
      CASE WHEN (edge LIKE 'fw%') = (nx = next_key) THEN '+' ELSE '-' END AS target_strand, weight AS count FROM e""",
    "traversal_depth_2": f"""WITH {_SEEDS}, r1 AS MATERIALIZED (SELECT dbg.*, 0 AS colour FROM dbg WHERE key IN (SELECT next_key FROM ({_nexts('seeds')})) AND key NOT IN (SELECT key FROM seeds)),
      r2 AS (SELECT dbg.*, 0 AS colour FROM dbg WHERE key IN (SELECT next_key FROM ({_nexts('r1')})) AND key NOT IN (SELECT key FROM seeds UNION ALL SELECT key FROM r1))
      SELECT key, {_COUNTS}, colour FROM seeds UNION ALL SELECT key, {_COUNTS}, colour FROM r1 UNION ALL SELECT key, {_COUNTS}, colour FROM r2""",
    "best_first": f"WITH RECURSIVE {_FOUND} SELECT * FROM pruned",
    "unitig_segments": f"WITH RECURSIVE {_UNITIGS} SELECT * FROM segments",
    "unitig_edges": f"WITH RECURSIVE {_UNITIGS} SELECT * FROM ends",
    "unitig_summary": f"""WITH RECURSIVE {_SIDES} SELECT segments, total_length, total_length / segments AS average_length, edges, edges / segments AS average_degree, (SELECT count(*) FROM parts) AS components,
      (SELECT max(size) FROM parts)::BIGINT AS largest_component, (2 * segments - (SELECT count(*) FROM degree))::BIGINT AS dead_ends, (SELECT count(*) FROM forks WHERE a IN (SELECT z FROM across) OR b IN (SELECT z FROM across)) AS bubbles, circular FROM sizes, lines""",
    "graph_export": f"""WITH RECURSIVE {_UNITIGS} SELECT 0 AS part, 'H' || chr(9) || 'VN:Z:1.2' AS line UNION ALL SELECT 1, concat_ws(chr(9), 'S', name, sequence, 'DP:f:' || depth, 'CB:Z:' || colour) FROM segments
      UNION ALL SELECT 2, concat_ws(chr(9), 'L', source, source_strand, target, target_strand, '{K - 1}M', 'KC:i:' || count) FROM ends""",
    "variant_calls": f"WITH RECURSIVE {_WALKS} {_CALLS}",
    "variant_graph": f"""WITH RECURSIVE {_GRAPHED} SELECT DISTINCT source, '+' AS source_strand, target, '+' AS target_strand, '0M' AS overlap FROM (
      SELECT u AS source, w AS target FROM joins WHERE m IS NULL UNION ALL SELECT u, m FROM joins WHERE m IS NOT NULL UNION ALL SELECT m, w FROM joins WHERE m IS NOT NULL)""",
    "fastq_roundtrip": f"SELECT item_id::VARCHAR AS header, 'item' AS comment, e AS sequence, repeat('!', length(e)) AS quality FROM (SELECT item_id, {_ENC} AS e FROM benchmark)",
    "gfa_assembly": _BOTH_WAYS,
    "gfa2_assembly": _BOTH_WAYS,
    "bed_positions": f"""WITH {_IV} SELECT header, unnest(generate_series("begin", "end" - 1)) AS position FROM iv""",
    "coordinate_lookup": f"""WITH {_trk(True)}, hi AS (SELECT segment_id, max(abs_pos) + 1 AS hi FROM t WHERE path = '22' GROUP BY segment_id HAVING min(abs_pos) <= 1 AND max(abs_pos) >= 1)
      SELECT path, 2::BIGINT AS "begin", 40::BIGINT AS "end", abs_pos, cov, "right", "left" FROM t JOIN hi USING (segment_id) WHERE path = '22' AND abs_pos >= 1 AND abs_pos < least(39, hi)""",
    "binary_track_roundtrip": f"""WITH {_trk(True)} SELECT path, dense_rank() OVER (PARTITION BY path ORDER BY segment_id) - 1 AS segment_id, pos, abs_pos, cov, "right", "left", {K}::BIGINT AS k FROM t""",
    "base_codes": f"SELECT item_id::VARCHAR AS header, lower(left(e, 1)) AS base, CASE WHEN left(e, 1) <> 'N' THEN instr('ACGT', left(e, 1)) - 1 END::INT AS code, CASE WHEN left(e, 1) <> 'N' THEN left(e, 1) END AS decoded FROM (SELECT item_id, {_ENC} AS e FROM benchmark)",
    "kmer_lookup": f"WITH {_counts()} SELECT * FROM dbg WHERE key = (SELECT min(key) FROM dbg)",
    "colour_names": f"WITH {_SEEDS} SELECT CASE colour WHEN 0 THEN 'gray' WHEN 1 THEN 'blue' ELSE 'red' END AS colour, count(*) AS n_kmers FROM seeds GROUP BY 1",
    "prune_above_cutoff": f"WITH {_SEEDS}, {_pruned('seeds', 2)} SELECT * FROM pruned",
    "vcf_file": f"""WITH RECURSIVE {_WALKS}, c AS ({_CALLS}) SELECT {len(variants.VCF_HEAD) + 1} AS part, concat_ws(chr(9), chrom, pos, '.', ref, alt, '0', 'PASS', '.', 'GT:GQ', '1/1:0') AS line FROM c
      UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{h}')" for i, h in enumerate(variants.VCF_HEAD))}, ({len(variants.VCF_HEAD)}, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'SAMPLE')))""",
}
ORACLES["inflate_track"] = ORACLES["step_track"]
