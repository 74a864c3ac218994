from __future__ import annotations

import random
from collections import Counter

from helixframe.functions.bases import LARGEST
from helixframe.operators import assembly, evaluate, graph, tracks, windows

RNG = random.Random(3)
SEQ = "".join(RNG.choice("ACGT") for _ in range(120))
K = 7


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(reads, k):
    out = {}
    for read in reads:
        for run in "".join(c if c in "ACGT" else " " for c in read.upper()).split():
            for p in range(len(run) - k + 1):
                w = run[p : p + k]
                left, right = run[p - 1] if p else None, run[p + k] if p + k < len(run) else None
                key = min(w, rc(w))
                f, b = (right, left) if w <= rc(w) else (left and rc(left), right and rc(right))
                node = out.setdefault(key, [0] * 9)
                node[0] += 1
                if f:
                    node[1 + "ACGT".index(f)] += 1
                if b:
                    node[5 + "ACGT".index(b)] += 1
    return out


def frame(spark, rows, name="sequence"):
    return spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(rows)], f"header string, {name} string")


def as_dict(dbg):
    return {r[0]: list(r[1:]) for r in dbg.select("key", *graph.COUNTS).collect()}


READS = [SEQ[:50], SEQ[30:90].lower(), "ACGN" + SEQ[60:], rc(SEQ[10:70]), "ACG", "", None, "NNNN"]


def test_build_matches_brute_force(spark):
    assert as_dict(graph.build(frame(spark, READS), K)) == brute([r or "" for r in READS], K)


def test_palindromes_and_even_k(spark):
    rows = ["ACGTACGTACGT", "GGATCCGGATCC"]
    assert as_dict(graph.build(frame(spark, rows), 4)) == brute(rows, 4)


def test_strand_invariance(spark):
    one, two = graph.build(frame(spark, [SEQ]), K), graph.build(frame(spark, [rc(SEQ)]), K)
    assert as_dict(one) == as_dict(two)


def test_union_equals_joint_build(spark):
    a, b = frame(spark, READS[:3]), frame(spark, READS[3:])
    joint = graph.build(frame(spark, READS), K)
    assert as_dict(graph.merge([graph.build(a, K), graph.build(b, K)])) == as_dict(joint)


def test_counts_saturate(spark):
    row = [("A" * K, LARGEST - 1, *([5] * 8))]
    d = spark.createDataFrame(row * 2, "key string, " + ", ".join(f"{c} long" for c in graph.COUNTS))
    assert as_dict(graph.merge([d, d]))["A" * K][0] == LARGEST


def test_stats_and_histogram(spark):
    own = brute([r or "" for r in READS], K)
    d = graph.build(frame(spark, READS), K)
    s = graph.stats(d, K).first()
    assert (s.total, s.distinct, s.unique) == (sum(v[0] for v in own.values()), len(own), sum(v[0] == 1 for v in own.values()))
    assert s.missing == 4**K - len(own)
    assert s.edges == sum(sum(v[1 + w] > 0 or v[5 + w] > 0 for w in range(4)) for v in own.values())
    assert {r.cov: r.n_kmers for r in graph.histogram(d).collect()} == Counter(v[0] for v in own.values())


def test_empty_reads(spark):
    d = graph.build(frame(spark, ["A"]).limit(0), K)
    assert graph.stats(d, K).first().total == 0
    assert evaluate.scores(evaluate.track(frame(spark, ["AC"]), d, K), K).count() == 2


def test_segments_have_offsets(spark):
    found = windows.segments(frame(spark, ["ACGTnnNACG", "NAC", "ACGT", "NNN"])).collect()
    assert sorted((r.path, r.segment_id, r.abs_start, r.raw) for r in found) == [("s0", 0, 0, "ACGT"), ("s0", 1, 7, "ACG"), ("s1", 0, 1, "AC"), ("s2", 0, 0, "ACGT")]


def test_long_sequence_is_chunked(spark):
    s = "".join(RNG.choice("ACGT") for _ in range(40_000))
    rows = windows.windows(windows.segments(frame(spark, [s])), 21, keep=("path",))
    got = {r.pos: r.kmer for r in rows.select("pos", "kmer").collect()}
    assert len(got) == len(s) - 20 and all(s[p : p + 21] == v for p, v in got.items())


def test_track_and_scores(spark):
    d = graph.build(frame(spark, [SEQ]), K)
    wrong = SEQ[:60] + ("A" if SEQ[60] != "A" else "C") + SEQ[61:]
    rows = evaluate.track(frame(spark, [SEQ, wrong]), d, K)
    t = {r.path: r for r in evaluate.totals(rows, by=("path",)).collect()}
    assert t["s0"].missing == 0 and 0 < t["s1"].missing <= K
    one = {r.method: r for r in evaluate.scores(rows, K).collect()}
    assert abs(one["kmer"].error - (1 - (1 - one["kmer"].missing / one["kmer"].total) ** (1 / K))) < 1e-12
    assert evaluate.scores(rows.where("path = 's0'"), K).first().qv == float("inf")
    inner = [r for r in rows.where("path = 's0'").collect() if 0 < r.pos < r.kcount - 1]
    assert all(r.left > 0 and r.right > 0 for r in inner)


def test_lookup_clips_to_the_segment(spark):
    d = graph.build(frame(spark, [SEQ]), K)
    rows = evaluate.track(frame(spark, [SEQ[:40] + "NNN" + SEQ[43:80]]), d, K, whole=True)
    wanted = spark.createDataFrame([("s0", 35, 60), ("s0", 1, 4), ("s0", 42, 44), ("x", 1, 5)], "header string, begin long, end long")
    got = {}
    for r in tracks.lookup(rows, wanted).collect():
        got.setdefault(r.begin, []).append(r.abs_pos)
    assert sorted(got[35]) == list(range(34, 40)) and sorted(got[1]) == [0, 1, 2] and 42 not in got


def test_covering_pads_with_zeros(spark):
    d = graph.build(frame(spark, [SEQ]), K)
    rows = evaluate.track(frame(spark, [SEQ[:30]]), d, K, whole=True)
    first = tracks.covering(rows, K).where("pos = 1").first()
    assert first.cov_k[: K - 2] == [0] * (K - 2) and len(first.cov_k) == K and first.cov_k[-1] > 0


def test_length_summary(spark):
    d = spark.createDataFrame([(10,), (20,), (30,), (40,)], "length long")
    r = assembly.length_summary(d).first()
    assert (r.n, r.total, r.n50, r.l50, r.largest, r.smallest) == (4, 100, 30, 2, 40, 10) and abs(r.aun - 30) < 1e-9
    assert assembly.length_summary(d.limit(0)).first().n50 == 0


def test_counts_of_the_assembly_alone(spark, monkeypatch):
    """Few k-mers filter the windows, many the counts; both give the graph's own rows."""
    reads, asm = frame(spark, READS), frame(spark, [SEQ[20:50], "ACGTACGTACG"])
    whole = as_dict(graph.build(reads, K))
    keys = {r.key for r in graph.assembly_keys(asm, K).collect()}
    for few in (1 << 19, 3):
        monkeypatch.setattr(graph, "FEW", few)
        assert as_dict(graph.build(reads, K, only=graph.assembly_keys(asm, K))) == {k: v for k, v in whole.items() if k in keys}


def test_windows_at_the_ends_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 10)
    monkeypatch.setattr(windows, "PIECE", 4)
    rows = {r.pos: r for r in windows.windows(windows.segments(frame(spark, [SEQ])), K, whole=True).collect()}
    assert len(rows) == len(SEQ)
    for p in range(len(SEQ)):
        w = SEQ[p : p + K] if p + K <= len(SEQ) else None
        assert rows[p].kmer == w and rows[p].key == (w and min(w, rc(w))) and rows[p].left == (SEQ[p - 1] if p else None) and rows[p].right == (SEQ[p + K] if p + K < len(SEQ) else None)
