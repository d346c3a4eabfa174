"""Cycles and layouts of small graphs."""

from __future__ import annotations

import random

from tallyspark.operators import graph


def unplaceable(edges: set[tuple[int, int]]) -> set[int]:
    """What stays when nodes without parents, and nodes without children, are taken away again and again."""
    while True:
        left = {(c, p) for c, p in edges if any(x == p for x, _ in edges) and any(y == c for _, y in edges)}
        if left == edges:
            return {x for e in edges for x in e}
        edges = left


def test_cycles(spark):
    r = random.Random(3)
    for n in (5, 12, 25):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(n)}
        found = graph.on_cycles(spark.createDataFrame([*edges, (None, 1)], "c int, p int"), "c", "p")
        assert {x.node for x in found.collect()} == unplaceable(edges)
    assert graph.on_cycles(spark.createDataFrame([], "c int, p int"), "c", "p").count() == 0


def test_long_chains_have_no_cycle(spark):
    """Chains of more nodes than a thousand rounds from both ends would take away, with a cycle of three nodes beside them."""
    chain = [(i, i + 1) for i in range(2_100)]
    found = graph.on_cycles(spark.createDataFrame([*chain, (9_001, 9_002), (9_002, 9_003), (9_003, 9_001), (9_000, 9_001)], "c int, p int"), "c", "p")
    assert {x.node for x in found.collect()} == {9_001, 9_002, 9_003}


def test_layout(spark):
    nodes = spark.createDataFrame([("d", x, i) for i, x in enumerate("abcdef")] + [("loop", "x", 0), ("loop", "y", 1), ("alone", "z", 0)], "k string, node string, place int")
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "a", "c"), ("d", "b", "d"), ("d", "a", "d"), ("d", "f", "f"), ("d", "q", "a"), ("loop", "x", "y"), ("loop", "y", "x")], "k string, source string, target string")
    found = {(r.k, r.node): (r["rank"], r.row, r.column) for r in graph.layout(nodes, edges, "k", per_row=2).collect()}
    assert {n: found["d", n][0] for n in "abcdef"} == {"a": 0, "e": 0, "f": 0, "b": 1, "c": 1, "d": 2}
    assert [found["d", n][1:] for n in "aefbcd"] == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (3, 0)]
    assert found["loop", "x"][0] == found["loop", "y"][0] == 0 and found["alone", "z"] == (0, 0, 0)
    assert len(found) == 9
