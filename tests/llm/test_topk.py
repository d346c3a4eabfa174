"""Exact top-k against all inner products."""

from __future__ import annotations

import math
import random

import pytest
from tallyspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], k: int = 10) -> list[tuple]:
    usable = {}
    for i, x, *_ in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            usable[i] = [math.floor(1024 * c) for c in x]
    out = []
    for q in usable:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(usable[q], usable[c])), c) for c in usable if c != q))
            out += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def data(n: int) -> list[tuple]:
    r = random.Random(n)
    rows = [(i, [r.choice((0.0, 0.25, -0.5, r.random() * 2 - 1)) for _ in range(16)], 1) for i in range(n)]
    for i in range(0, n, 7):  # ties
        rows[i] = (i, [0.5] * 16, 0)
    rows += [(9000, None, 0), (9100, [1.0, None] * 8, 0), (9200, [math.nan] * 16, 0), (9300, [math.inf] * 16, 0), (None, [1.0] * 16, 0), (9400, [], 0), (9500, [0.0] * 16, 0)]
    return rows


@pytest.mark.parametrize(("block", "query_block"), [(8192, 4096), (50, 3)])
def test_search_is_exact_in_any_blocks(spark, block, query_block):
    rows = data(400)
    vectors = topk.quantise(spark.createDataFrame(rows, SCHEMA))
    found = topk.search(vectors.where("vec_id % 100 = 0"), vectors, block=block, query_block=query_block)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_dense_vectors_in_any_order(spark):
    """Terms that every row has, rows dealt in no order."""
    r = random.Random(12)
    rows = [(i, [r.random() + 0.1 for _ in range(8)], 0) for i in range(300)]
    r.shuffle(rows)
    vectors = topk.quantise(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, topk.search(vectors.where("vec_id % 100 = 0"), vectors, block=64).collect())) == plain(rows)


def test_repeated_rows_count_once_and_few_candidates_are_all_returned(spark):
    rows = [(i, [float(i % 3), 1.0], 0) for i in (0, 100, 3, 4)]
    vectors = topk.quantise(spark.createDataFrame(rows + rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS v"))
    found = topk.search(vectors.where("vec_id % 100 = 0"), vectors)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_empty(spark):
    none = topk.quantise(spark.createDataFrame([], SCHEMA))
    some = topk.quantise(spark.createDataFrame(data(10), SCHEMA))
    assert topk.search(none, none).count() == topk.search(none, some).count() == topk.search(some, none).count() == 0
