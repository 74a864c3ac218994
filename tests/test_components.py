from __future__ import annotations

import random

import pytest

from helixframe import scratch
from helixframe.operators import components
from helixframe.operators.components import connected_components


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def labels(spark, pairs, kind="long"):
    edges = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
    return {r.node: r.label for r in connected_components(edges).collect()}


def test_random_graphs(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    want = union_find(pairs)
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert labels(spark, pairs) == {k: v for k, v in want.items() if k not in alone}


def test_names_and_empty(spark):
    assert labels(spark, [("b", "a"), ("c", "b"), ("x", "y")], "string") == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert labels(spark, [(1, 1)]) == {}


@pytest.mark.parametrize("size", [2000, 100_000])
def test_long_chains_settle_in_few_rounds(spark, size, monkeypatch):
    ids = list(range(size))
    random.Random(2).shuffle(ids)
    rounds = []
    own = components._moves
    monkeypatch.setattr(components, "_moves", lambda *a: rounds.append(1) or own(*a))
    found = labels(spark, list(zip(ids, ids[1:], strict=False)))
    assert len(found) == size and set(found.values()) == {0} and len(rounds) < 25


def test_a_star_takes_two_rounds(spark, monkeypatch):
    rounds = []
    own = components._moves
    monkeypatch.setattr(components, "_moves", lambda *a: rounds.append(1) or own(*a))
    assert set(labels(spark, [(500, i) for i in range(1000) if i != 500]).values()) == {0} and len(rounds) <= 3


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session())
