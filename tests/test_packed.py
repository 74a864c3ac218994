from __future__ import annotations

import random

import pytest

from helixframe.functions.bases import LARGEST
from helixframe.operators import graph, packed, subgraph
from tests.test_graph import as_dict, brute, frame, rc

RNG = random.Random(5)
SEQ = "".join(RNG.choice("ACGT") for _ in range(300))
READS = [SEQ, SEQ[40:200].lower(), rc(SEQ[90:]), SEQ[:70] + "NNéN" + SEQ[100:150], "ACG", "", None]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("k", [1, 4, 21, 29, 30, 32])
def test_blocks_count_as_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(packed, "CUT", 50)
    assert as_dict(graph.build(frame(spark, READS), k)) == brute([r or "" for r in READS], k)


def test_counting_shuffles_blocks_once(spark):
    built = graph.build(frame(spark, READS), 21)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert exchanges(built) == 1 and "hashpartitioning(bucket" in plan and "hashpartitioning(key" not in plan


def test_a_union_of_built_graphs_shuffles_once(spark):
    one, two = graph.build(frame(spark, READS[:2]), 21), graph.build(frame(spark, READS[2:]), 21)
    both = graph.merge([one, two])
    assert exchanges(both) == 1
    assert as_dict(both) == brute([r or "" for r in READS], 21)


@pytest.mark.parametrize("k", [7, 31])
def test_tables_are_packed_and_saturate(spark, k):
    rows = [("A" * k, LARGEST - 1, 5, 0, 300, 0, LARGEST, 0, 0, 1), ("C" * k, 2, *[0] * 8)]
    d = spark.createDataFrame(rows, packed.GRAPH)
    assert as_dict(graph.merge([d, d], k)) == {"A" * k: [LARGEST, 10, 0, 600, 0, LARGEST, 0, 0, 2], "C" * k: [4, *[0] * 8]}


def test_streamed_deltas_are_blocks(spark, tmp_path):
    from helixframe.streaming.ingest import BatchMerger

    merger = BatchMerger(spark, str(tmp_path / "s"), 21)
    merger(frame(spark, READS[:3]), 0)
    merger(frame(spark, READS[3:]), 1)
    merger(frame(spark, READS[3:]), 1)
    assert "steps" in spark.read.parquet(str(tmp_path / "s" / "delta")).columns
    assert exchanges(merger.graph()) == 1
    assert as_dict(merger.graph()) == brute([r or "" for r in READS], 21)


def snps(s, *at):
    for i in at:
        s = s[:i] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[i]] + s[i + 1 :]
    return s


def walked(counts, starts, k, steps):
    """Keys on walks of at most ``steps`` steps between k-mers of ``starts``, by brute force."""
    def onward(w):
        row = counts.get(min(w, rc(w)), [0] * 9)
        return [w[1:] + b for i, b in enumerate("ACGT") if (row[1 + i] if w <= rc(w) else row[8 - i])]

    hops, frontier = {w: 0 for w in starts}, list(starts)
    for hop in range(1, steps + 1):
        frontier = [n for n in {n for w in frontier for n in onward(w)} if n not in hops]
        hops |= dict.fromkeys(frontier, hop)
    return {min(w, rc(w)) for w, hop in hops.items() if hop + hops.get(rc(w), steps + 1) <= steps and min(w, rc(w)) in counts}


def test_the_corridor_holds_every_walk_and_little_else(spark):
    k = 21
    far = ["".join(RNG.choice("ACGT") for _ in range(400)) for _ in range(5)]
    own = [SEQ, snps(SEQ, 60), snps(SEQ, 150, 165), rc(snps(SEQ, 230)), SEQ[:120] + SEQ[124:], *far]
    whole = brute(own, k)
    starts = {w for i in range(len(SEQ) - k + 1) for w in (SEQ[i : i + k], rc(SEQ[i : i + k]))}
    wanted = walked(whole, starts, k, k + 1)
    near = as_dict(subgraph.corridor(frame(spark, [SEQ]), frame(spark, own), k))
    assert len(wanted) > len(SEQ) and wanted <= near.keys()
    assert all(whole[w] == near[w] for w in near) and len(near) < len(whole) - 1500


def test_what_lies_within_two_steps(spark):
    k = 21
    reads = frame(spark, [SEQ, snps(SEQ, 60), rc(snps(SEQ, 150)), snps(SEQ[::-1], 5)])
    asm, whole = frame(spark, [SEQ[:100]]), graph.build(reads, k).cache()
    near = graph.build(reads, k, near=graph.around(graph.assembly_keys(asm, k), k, within=2)).cache()
    assert near.count() < whole.count()
    start = subgraph.seeds(asm, whole, k)
    assert as_dict(subgraph.traversal(start, near, 2)) == as_dict(subgraph.traversal(start, whole, 2))


def test_pieces_are_counted_for_the_assembly_alone(spark, monkeypatch):
    from helixframe.plans import catalog

    asked, build = [], graph.build
    monkeypatch.setattr(graph, "build", lambda *a, **b: asked.append(b.get("only")) or build(*a, **b))
    catalog.edge_missing(spark, "/root/testdata/sf0.001")
    assert asked[0] is not None
