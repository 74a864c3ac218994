"""K-d shards against a brute-force tree, by target bytes, at many leaves, and on awkward rows."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import sharding


def table(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, f"t{i}", r.random() * 50, r.randrange(6), r.randrange(1, 60)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, x double, y int, bytes long"), rows


def brute(rows, leaves):
    """doc_id -> leaf: recursive splits at the exact weighted median of the widest scaled dimension (keys are distinct in x)."""
    spans = [(min(r[d] for r in rows), max(r[d] for r in rows)) for d in (2, 3)]
    top = (1 << sharding.COORDINATE) - 1

    def at(r, i):
        low, high = spans[i]
        return math.floor((r[2 + i] - low) / (high - low) * top)

    out = {}

    def split(own, first, count):
        if count == 1:
            out.update({r[0]: first for r in own})
            return
        wide = max((0, 1), key=lambda i: (max(at(r, i) for r in own) - min(at(r, i) for r in own), -i))
        left = math.ceil(count / 2)
        want, below, best = sum(r[4] for r in own) * left / count, 0, None
        groups = defaultdict(list)
        for r in own:
            groups[at(r, wide)].append(r)
        cut, miss = 0, float("inf")
        for c in sorted(groups):
            if abs(below - want) < miss:
                cut, miss = c, abs(below - want)
            below += sum(r[4] for r in groups[c])
        if abs(below - want) < miss:
            cut = top + 1
        split([r for r in own if at(r, wide) < cut], first, left)
        split([r for r in own if at(r, wide) >= cut], first + left, count - left)

    split(rows, 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [2, 5])
def test_cuts_are_the_exact_weighted_medians(spark, monkeypatch, leaves):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    d, rows = table(spark, 300)
    own = [(i, t, x, 0, b) for i, t, x, _, b in rows]
    d = spark.createDataFrame([(*r[:3], 0, r[4]) for r in rows], d.schema)
    spread = [(*r[:3], r[2], r[4]) for r in own]  # one dimension counts: the other never varies
    got = {r.doc_id: r.shard for r in sharding.kd_shards(d, F.col("bytes"), ["x", "y"], leaves=leaves).collect()}
    want = brute(spread, leaves)
    assert got == want


def test_the_widest_dimension_is_split(spark):
    d = spark.createDataFrame([(i, f"t{i}", float(i % 2), i, 10) for i in range(64)] + [(99, "z", 0.4, 40, 1)], "doc_id long, text string, x double, y int, bytes long")
    got = defaultdict(set)
    for r in sharding.kd_shards(d, F.col("bytes"), ["x", "y"], leaves=2, carry=("x",)).collect():
        got[r.x].add(r.shard)
    assert got[0.0] != got[1.0]  # both spans are whole, so the first dimension is cut


def test_leaves_follow_from_the_target(spark):
    d, rows = table(spark, 2000)
    total = sum(r[4] for r in rows)
    found = sharding.kd_shards(d, F.col("bytes"), ["x", "y"], target=total // 12).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(found) == 13 and all(abs(r.b - total / 13) <= 0.03 * total / 13 for r in found)


def test_a_thousand_leaves(spark):
    d = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.rand(3).alias("x"), F.rand(4).alias("y"), F.lit(100).cast("long").alias("bytes"))
    found = sharding.kd_shards(d, F.col("bytes"), ["x", "y"], leaves=1024).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("s")).collect()
    assert {r.shard for r in found} == set(range(1024)) and all(30 <= r.n <= 50 and r.s == r.n - 1 for r in found)


def test_odd_kinds_of_columns(spark):
    rows = [(f"id{i}", None if i % 5 == 0 else f"t{i % 3}", float("nan") if i % 4 == 0 else i / 7, None if i % 3 else "é", i % 2 == 0) for i in range(60)] * 2
    d = spark.createDataFrame(rows, "doc_id string, text string, shard double, slot string, tail boolean")
    out = sharding.kd_shards(d, F.length(F.coalesce("text", F.lit(""))) + 1, ["shard", "slot", "tail"], leaves=3)
    assert out.count() == 120 and {r.shard for r in out.collect()} <= {0, 1, 2}
    assert sharding.kd_shards(d.limit(0), F.lit(1), ["shard"], target=10).count() == 0
