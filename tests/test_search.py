from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bases
from helixframe.operators import graph, subgraph, unitigs, variants
from helixframe.plans import catalog
from tests.test_graph import frame, rc

RNG = random.Random(11)
SEQ = "".join(RNG.choice("ACGT") for _ in range(90))
K = 11


def snp(s, at):
    return s[:at] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[at]] + s[at + 1 :]


@pytest.fixture(scope="module")
def bubble(spark):
    """A graph of a sequence and its point variant; the assembly is the sequence alone."""
    path = graph.build(frame(spark, [SEQ, snp(SEQ, 45)]), K).cache()
    return path, frame(spark, [SEQ])


def test_best_first_keeps_the_alternate_path(bubble):
    dbg, asm = bubble
    near = subgraph.extract(asm, dbg, K, depth=K)
    assert near.count() == (90 - K + 1) + K
    assert subgraph.extract(asm, dbg, K, depth=K - 1).count() == 90 - K + 1


def test_traversal_reaches_by_rounds(bubble):
    dbg, asm = bubble
    assert subgraph.extract(asm, dbg, K, algorithm="traversal", depth=3).count() == (90 - K + 1) + 6


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        subgraph.default_depth(K, "random")


def test_tips_are_dropped(spark):
    dbg = graph.build(frame(spark, [SEQ, SEQ[:50] + "ACGGTCATTGCA"]), K)
    assert subgraph.extract(frame(spark, [SEQ]), dbg, K, depth=20).count() == 90 - K + 1


def test_unitigs_of_a_bubble(bubble):
    dbg, asm = bubble
    nodes = subgraph.extract(asm, dbg, K)
    segments, edges = unitigs.unitigs(nodes)
    found = {r.sequence for r in segments.collect()}
    assert len(found) == 4
    for s in (SEQ[: 34 + K], SEQ[46:]):
        assert s in found or rc(s) in found
    r = unitigs.graph_summary(segments, edges).first()
    assert (r.segments, r.edges, r.components, r.dead_ends) == (4, 4, 1, 2)
    assert unitigs.gfa_lines(segments, edges, K).count() == 9


def test_two_bubbles_are_counted(spark):
    both = frame(spark, [SEQ, snp(SEQ, 30), snp(SEQ, 60)])
    nodes = subgraph.extract(frame(spark, [SEQ]), graph.build(both, K), K)
    assert unitigs.graph_summary(*unitigs.unitigs(nodes)).first().bubbles == 2


def test_circular_unitig(spark):
    ring = SEQ[:40]
    nodes = subgraph.seeds(frame(spark, [ring + ring[: K + 1]]), graph.build(frame(spark, [ring + ring + ring]), K), K)
    segments, edges = unitigs.unitigs(subgraph.prune_edges(nodes))
    assert segments.count() == 1 and segments.first().n_kmers == 40
    assert unitigs.graph_summary(segments, edges).first().circular == 1


def test_edges_of_nodes_come_from_both_ends(spark):
    nodes = subgraph.prune_edges(subgraph.seeds(frame(spark, [SEQ]), graph.build(frame(spark, [SEQ]), K), K))
    assert unitigs.node_graph(nodes)[1].count() == 2 * (90 - K)


@pytest.mark.parametrize(
    ("change", "kind", "alt"),
    [(lambda s: snp(s, 45), "SNV", SEQ[45]), (lambda s: s[:45] + s[46:], "DEL", None), (lambda s: s[:45] + {"A": "C", "C": "A", "G": "T", "T": "G"}[s[45]] + s[45:], "INS", "")],
)
def test_variants(spark, change, kind, alt):
    dbg = graph.build(frame(spark, [SEQ]), K)
    found = variants.variants(frame(spark, [change(SEQ)]), dbg, K, span=K, depth=2 * K).collect()
    assert [r.type for r in found] == [kind]
    if alt is not None:
        assert found[0].alt == alt


def test_vcf_restores_the_sequence(spark):
    asm = frame(spark, [snp(SEQ, 45)])
    rows = variants.vcf_rows(variants.variants(asm, graph.build(frame(spark, [SEQ]), K), K), asm).collect()
    assert [(r.pos, r.ref, r.alt) for r in rows] == [(46, snp(SEQ, 45)[45], SEQ[45])]
    nodes, edges = variants.variant_graph(variants.variants(asm, graph.build(frame(spark, [SEQ]), K), K), asm)
    assert nodes.count() == 4 and edges.count() == 4


def test_no_variants(spark):
    dbg = graph.build(frame(spark, [SEQ]), K)
    assert variants.variants(frame(spark, [SEQ]), dbg, K).count() == 0


def test_catalogue_extracts_at_the_full_depth(spark, tmp_path):
    """The queries keep the alternate walk of a substituted base, which has k new nodes."""
    letter = {b: ch for ch, b in zip(bases.LETTERS, bases.LETTER_BASES, strict=True)}
    plain, other = ("".join(letter[b] for b in s) for s in (SEQ, snp(SEQ, 45)))
    spark.createDataFrame([(0, plain), (1, other)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # the passage whose substituted bases are those of SEQ
    before = "".join("TACG"["ACGT".index(b)] if i >= catalog.FIRST and (i - catalog.FIRST) % catalog.STEP == 0 else b for i, b in enumerate(SEQ))
    passage = "".join(letter[b] for b in before)
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert catalog.changed_contigs(spark, str(tmp_path)).first().sequence == SEQ
    k, d = catalog.K, str(tmp_path)
    found = {r.colour: r["count"] for r in catalog.best_first(spark, d).groupBy("colour").count().collect()}
    assert found == {subgraph.SHARED: 90 - k + 1, subgraph.FOUND: k}
    assert catalog.unitig_segments(spark, d).count() == 4 and catalog.unitig_edges(spark, d).count() == 4
    r = catalog.unitig_summary(spark, d).first()
    assert (r.segments, r.edges, r.components, r.dead_ends) == (4, 4, 1, 2)
    assert catalog.graph_export(spark, d).count() == 9


def test_walks_of_a_source(spark):
    """Three alternates of one base meet the assembly at one window, which a source visits once; ``most`` bounds the walks of a source."""
    others = [SEQ[:45] + b + SEQ[46:] for b in "ACGT" if b != SEQ[45]]
    dbg = graph.build(frame(spark, [SEQ, *others]), K).cache()
    asm = frame(spark, [SEQ])
    for most in (None, 1):
        assert [r.alt for r in variants.variants(asm, dbg, K, most=most).collect()] == [min(b for b in "ACGT" if b != SEQ[45])]
    assert variants.variants(asm, dbg, K, most=0).count() == 0


def test_long_paths_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(unitigs, "RUN", 7)
    nodes = subgraph.prune_edges(subgraph.seeds(frame(spark, [SEQ]), graph.build(frame(spark, [SEQ]), K), K))
    (row,) = unitigs.unitigs(nodes)[0].collect()
    assert row.sequence in (SEQ, rc(SEQ)) and row.n_kmers == 90 - K + 1 and row.depth == 1.0


def test_second_version_graph_lines(bubble):
    dbg, asm = bubble
    segments, edges = unitigs.unitigs(subgraph.extract(asm, dbg, K))
    rows = segments.withColumn("tags", F.lit("")), edges.withColumn("overlap", F.lit(K - 1)).withColumn("tags", F.lit("KC:i:1"))
    lines = [r.line.split("\t") for r in unitigs.graph_lines(*rows, 2).collect()]
    size = {f[1]: int(f[2]) for f in lines if f[0] == "S"}
    text = {f[1]: f[3] for f in lines if f[0] == "S"}
    assert len(size) == 4 and all(len(text[n]) == s for n, s in size.items()) and ["H", "VN:Z:2.0"] in lines
    for f in (f for f in lines if f[0] == "E"):
        pieces = []
        for ref, begin, end in ((f[2], f[4], f[5]), (f[3], f[6], f[7])):
            name, strand = ref[:-1], ref[-1]
            assert end.endswith("$") == (int(end.rstrip("$")) == size[name])
            piece = text[name][int(begin) : int(end.rstrip("$"))]
            pieces.append(piece if strand == "+" else rc(piece))
        assert pieces[0] == pieces[1] and len(pieces[0]) == K - 1
