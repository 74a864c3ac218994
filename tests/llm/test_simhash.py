"""Vantage-point searches against all pairs: local trees, distributed splits, dense points, cells, and chains."""

from __future__ import annotations

import numpy as np
import pytest

from helixframe.llm import simhash
from helixframe.llm.components import connected_components

RNG = np.random.default_rng(6)


def brute(points, radius):
    """Labels of the components by comparing all pairs."""
    labels = np.arange(len(points))
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius)
        old = np.unique(labels[near])
        labels[np.isin(labels, old)] = old[0]
    return labels


def same(one, two):
    pairs = set(zip(one.tolist(), two.tolist(), strict=True))
    return len(pairs) == len(set(one.tolist())) == len(set(two.tolist()))


def clustered(centres, each, flips, noise):
    base = RNG.integers(0, 1 << 63, centres, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in RNG.choice(64, RNG.integers(1, flips + 1), replace=False))) for c in base for _ in range(each)]
    return np.unique(np.array([*base, *near, *RNG.integers(0, 1 << 63, noise, dtype=np.uint64)], np.uint64))


def component_labels(spark, points, links):
    found = {r.node: r.label for r in connected_components(links).collect()}
    signed = points.view(np.int64).tolist()
    return np.unique([found.get(p, p) for p in signed], return_inverse=True)[1]


def test_a_tree_prunes_and_is_exact():
    points, leaves = clustered(40, 30, 4, 500), []
    assert same(simhash.link_shard(points, 3, visited=leaves), brute(points, 3))
    assert max(leaves) < len(points) / 10 and sum(n * n for n in leaves) < len(points) ** 2 / 3  # the bounds did the work, not the comparison of all pairs


def test_branches_that_do_not_shrink():
    centre = np.uint64(RNG.integers(0, 1 << 62))
    points = np.unique(np.array([centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in RNG.integers(0, 12, (200, 2))], np.uint64))
    assert same(simhash.link_shard(points, 3, leaf=8), brute(points, 3))


@pytest.mark.parametrize(("cell", "leaf"), [(1 << 20, 60), (64, 1000), (64, 24)])
def test_distributed_shards_find_every_link(spark, monkeypatch, cell, leaf):
    """Without a filter, with cells alone, and with cells that are split again."""
    own = simhash.cell_masks
    monkeypatch.setattr(simhash, "cell_masks", lambda n, r: own(n, r, cell))
    points = clustered(12, 25, 4, 250)
    d = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    shards, _ = simhash._shards(d, 3, len(points), leaf)
    assert shards.groupBy("shard").count().where(f"count > {leaf}").isEmpty()
    assert same(component_labels(spark, points, simhash.near_links(d, 3, leaf=leaf)), brute(points, 3))


def test_points_that_no_vantage_point_parts(spark):
    centre = int(RNG.integers(0, 1 << 62))
    points = np.unique(np.array([centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in RNG.integers(0, 10, (200, 2))] + [centre ^ (0xFFFF << 40)], np.uint64))
    d = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    stuck = simhash._shards(d, 3, len(points), 8)[1]
    assert stuck is not None and stuck.count()
    assert same(component_labels(spark, points, simhash.near_links(d, 3, leaf=8)), brute(points, 3))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_meetings(spark, radius):
    points = clustered(2, 6, radius + 1, 3)
    d = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    assert same(component_labels(spark, points, simhash._meetings(d, radius)), brute(points, radius))


def test_cells_hold_every_near_pair():
    rng = np.random.default_rng(9)
    for count in (1000, 1 << 20, 1 << 30, 1 << 36):
        masks = simhash.cell_masks(count, 3)
        assert {m.bit_count() for m in masks} == {max(0, int(np.log2(count / simhash.CELL)))}
        for _ in range(300):
            diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(m & diff == 0 for m in masks)


def test_a_chain_of_near_copies_is_one_component(spark):
    chain, fp = [], int(RNG.integers(0, 1 << 62))
    for i in range(600):
        for b in RNG.choice(64, 2, replace=False):
            fp ^= 1 << int(b)
        chain.append(fp)
    points = np.unique(np.array(chain, np.uint64))
    d = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    assert len(set(component_labels(spark, points, simhash.near_links(d)).tolist())) == 1
