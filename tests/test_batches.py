"""Batches made in parts are those of one walk."""

from __future__ import annotations

import random

import pytest

from tallyspark.operators import packing


def plain(rows: list[tuple], most_items: int, most_bytes: int) -> dict:
    out: dict = {}
    state: dict = {}
    for key, n, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        batch, items, held = state.get(key, (0, 0, 0))
        if items and (items >= most_items or held + size > most_bytes):
            batch, items, held = batch + 1, 0, 0
        state[key] = (batch, items + 1, held + size)
        out[key, n] = batch
    return out


@pytest.mark.parametrize(("most_items", "most_bytes", "part"), [(5, 40, 7), (3, 1000, 16), (50, 30, 64), (1, 9, 4), (8, 0, 8)])
def test_parts_give_the_batches_of_a_walk(spark, most_items, most_bytes, part):
    r = random.Random(most_items)
    rows = [(k, i, r.choice((0, 1, 5, 9)) if most_bytes else 0) for k, n in (("hot", 500), ("b", 40), (None, 60), ("one", 1)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, n int, size int").repartition(5)
    found = packing.batch_rows(df, "key", ["n"], "size", most_items, most_bytes, part=part).collect()
    assert {(x.key, x.n): x.batch for x in found} == plain(rows, most_items, most_bytes) and len(found) == len(rows)


def test_what_fits_nowhere_and_nothing(spark):
    rows = [("a", i, 1) for i in range(40)] + [("b", i, 99 if i == 3 else 1) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, n int, size int")
    found = packing.batch_rows(df, "key", ["n"], "size", 4, 10, part=8).collect()
    assert {x.key for x in found} == {"a"} and len(found) == 40
    assert packing.batch_rows(df.limit(0), "key", ["n"], "size", 4, 10).count() == 0


def test_one_key_of_many_rows(spark):
    """A million rows of one key; each task takes a part."""
    df = spark.range(1_000_000).selectExpr("'k' AS key", "id AS n", "CAST(id * 7919 % 1000 AS INT) AS size")
    found = packing.batch_rows(df, "key", ["n"], "size", 20, 5000).groupBy("batch").agg({"size": "sum", "n": "count"}).collect()
    want = plain([("k", i, i * 7919 % 1000) for i in range(1_000_000)], 20, 5000)
    assert len(found) == max(want.values()) + 1 and sum(x["count(n)"] for x in found) == 1_000_000
    assert max(x["sum(size)"] for x in found) <= 5000 and max(x["count(n)"] for x in found) <= 20
