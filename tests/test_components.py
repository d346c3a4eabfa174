"""Strongly connected components against plain reachability, and the rounds that long chains take."""

from __future__ import annotations

import random

import pytest

from tallyspark.operators import graph


def plain(edges: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """(node, component) by what each node reaches."""
    after: dict[int, set[int]] = {}
    for c, p in edges:
        after.setdefault(p, set()).add(c)

    def reach(x: int) -> set[int]:
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    reached = {x: reach(x) for x in after}
    return {(x, max(y for y in r if x in reached.get(y, ()))) for x, r in reached.items() if x in r}


def told(spark, edges) -> set[tuple]:
    df = spark.createDataFrame(sorted(edges), "child int, parent int")
    return {tuple(r) for r in graph.cycle_components(df, "child", "parent").collect()}


RANDOM = random.Random(6)
GRAPHS = {
    "none": set(),
    "loop": {(1, 1), (2, 1)},
    "ring": {(i % 9 + 1, i) for i in range(1, 10)},
    "between": {(2, 1), (1, 2), (3, 2), (4, 3), (5, 4), (4, 5)},
    "handle": {(2, 1), (3, 2), (1, 3), (4, 1), (5, 4), (1, 5), (6, 5)},
    "nested": {(2, 1), (3, 2), (4, 3), (1, 4), (3, 1), (7, 4), (8, 7), (7, 8), (8, 8)},
    "sparse": {(RANDOM.randrange(40), RANDOM.randrange(40)) for _ in range(50)},
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_those_of_reachability(spark, name):
    assert told(spark, GRAPHS[name]) == plain(GRAPHS[name])


def test_a_long_chain_with_a_second_parent_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "materialise", lambda df, name, f=graph.materialise: (rounds.append(name), f(df, name))[1])
    chain = {(i + 1, i) for i in range(3000)} | {(2500, 10)}
    assert told(spark, chain) == set() and len(rounds) < 30
    rounds.clear()
    assert told(spark, chain | {(5, 2990)}) == {(i, 2990) for i in range(5, 2991)} and len(rounds) < 60


def test_rounds_of_the_cycle_check_are_not_broadcast(spark, tmp_path, monkeypatch):
    at, plans = str(tmp_path / "edges"), []
    spark.createDataFrame([(1, 2), (2, 1), (1, 3), (4, 1), (5, 4)], "c long, p long").write.parquet(at)
    write = graph.materialise

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "materialise", seen)
    assert sorted(r.node for r in graph.on_cycles(spark.read.parquet(at), "c", "p").collect()) == [1, 2]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
