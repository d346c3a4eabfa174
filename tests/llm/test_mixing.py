"""Source mixing against a plain water-filling of targets, and the words that the mixed texts really hold."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from cases import SCHEMA, documents, empty, prose, rows, told
from tallyspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if cap * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return target


def many() -> list[tuple]:
    out, i = [], 0
    for source, n in (("big", 120), ("mid", 40), ("small", 6), ("Ärger", 15), (None, 20), ("void", 3)):
        for _ in range(n):
            text = None if source == "void" else prose(i, 20 + i % 90)
            out.append((i, text, None, source, None))
            i += 1
    return out


def test_taken_words_come_near_targets_and_no_document_is_used_up_more_than_twice(spark):
    docs = many()
    found = mixing.taken_words(mixing.plan_mix(spark.createDataFrame(docs, SCHEMA), block_words=16)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in docs}
    source = {i: s for i, _, _, s, _ in docs}
    total: dict = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    want = plain_targets(dict(total))
    taken: dict = defaultdict(int)
    assert len(found) == len(docs)
    for r in found:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 32 + 0.02 * t, s


def test_reruns_and_other_partitions_agree(spark):
    df = spark.createDataFrame(many(), SCHEMA)
    first = told(mixing.taken_words(mixing.plan_mix(df)))
    assert first == told(mixing.taken_words(mixing.plan_mix(df.repartition(7))))
    assert first != told(mixing.taken_words(mixing.plan_mix(df, block_words=16, seed=3)))


def test_slots_take_each_block_once_a_pass(spark):
    plan = mixing.plan_mix(spark.createDataFrame(many(), SCHEMA), block_words=16)
    slots = plan.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)
    assert len({(r.key, r["pass"], r.block) for r in slots}) == len(slots)
    blocks = {r.key: r.n_blocks for r in plan.sources.collect()}
    assert all(0 <= r.block < blocks[r.key] and r["pass"] in (0, 1) for r in slots)


def test_permutations_are_whole_and_spread(spark):
    """For every number of blocks each index comes once a pass; what half a pass takes lies all over the index range."""
    sizes = [1, 2, 3, 5, 16, 25, 97, 1_000, 1_023, 4_099]
    x = spark.createDataFrame([(v,) for v in sizes], "n long").crossJoin(spark.createDataFrame([(7,), (8,)], "noise long"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    x = mixing.permuted(x, "k", "n", "noise", "at")
    order: dict = defaultdict(list)
    for r in x.orderBy("k").collect():
        order[r.n, r.noise].append(r["at"])
    for (size, noise), places in order.items():
        assert sorted(places) == list(range(size))
        if size >= 97:
            assert places != order[size, 15 - noise]
            tenths = [0] * 10
            for p in places[: size // 2]:
                tenths[p * 10 // size] += 1
            assert max(abs(t - size / 20) for t in tenths) < 5 * (size / 20) ** 0.5, (size, tenths)
            steps = [b - a for a, b in zip(places, places[1:], strict=False)]
            assert max(map(steps.count, steps)) < max(12, size / 50)  # no constant stride


def test_mixed_texts_hold_the_taken_words(spark):
    docs = spark.createDataFrame(many(), SCHEMA)
    plan = mixing.plan_mix(docs, block_words=16)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(plan).collect()}
    held: dict = defaultdict(int)
    words = {i: WORD.findall(t or "") for i, t, *_ in many()}
    mixed = mixing.mixed_documents(docs, plan)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got = WORD.findall(r.text)
        held[r.doc_id] += len(got)
        at = iter(words[r.doc_id])
        assert all(w in at for w in got)  # in the order of the text
    assert {i: n for i, n in taken.items() if n} == dict(held)


def test_table(spark):
    docs = documents(spark, clash=True).drop("key", "block")
    plan = mixing.plan_mix(documents(spark), block_words=16)
    found = mixing.taken_words(plan)
    assert found.count() == len(rows())
    held: dict = defaultdict(int)
    for r in mixing.mixed_documents(documents(spark), plan).collect():
        held[r.doc_id] += len(WORD.findall(r.text))
    want: dict = defaultdict(int)
    for r in found.collect():
        want[r.doc_id] += r.taken
    assert {i: n for i, n in want.items() if n} == dict(held)
    assert told(mixing.taken_words(mixing.plan_mix(docs, block_words=16))) == told(found)
    none = mixing.plan_mix(empty(spark))
    assert mixing.taken_words(none).count() == mixing.mixed_documents(empty(spark), none).count() == 0


def test_main_path_has_no_python(spark):
    plan = mixing.taken_words(mixing.plan_mix(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_small_sources_meet_their_targets_with_production_parameters(spark):
    """Sources far below the large one's level stop at twice their words; and one has a target that is no whole pass."""
    sizes = {"a": 6_000, "b": 10, "c": 70, "d": 200, "e": 15, "f": 65, "g": 1_025, "h": 4_097, "i": 1}
    docs = [(i, prose(i, n), None, s, None) for i, (s, n) in enumerate(sizes.items())]
    alone = [(1, prose(1, 60), None, "p", None), (2, prose(2, 100), None, "q", None), (3, prose(3, 130), None, "r", None)]
    for rows_of in (docs, alone):
        df = spark.createDataFrame(rows_of, SCHEMA)
        plan = mixing.plan_mix(df)
        size = {s: len(t.split()) for _, t, _, s, _ in rows_of}
        want = plain_targets(size)
        held = {r.doc_id: r.n for r in mixing.mixed_documents(df, plan).groupBy("doc_id").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
        for r in mixing.taken_words(plan).collect():
            s = next(x[3] for x in rows_of if x[0] == r.doc_id)
            assert abs(r.taken - want[s]) <= max(1, min(64, r.size / 16)), s
            assert r.doc_id in held, s
    assert any(t == 2 * sizes[s] for s, t in plain_targets(sizes).items()) and any(t % size[s] for s, t in want.items())


def test_a_mix_is_one_small_query_over_the_written_plan(spark):
    """Broadcasts and shuffles of a query that is all steps at once add up in the driver."""
    docs = spark.createDataFrame(many(), SCHEMA)
    for query in (mixing.mixed_documents(docs, mixing.plan_mix(docs)), mixing.taken_words(mixing.plan_mix(docs))):
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.count("Exchange") <= 16
