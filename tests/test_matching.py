"""All needles in all texts, against the plain test of each pair."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspark.operators import matching, retrieval

TEXTS = st.text(st.sampled_from("abcé漢\U0001f600 "), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=8), st.lists(TEXTS.filter(bool), max_size=12), st.integers(1, 12))
def test_any_needles_in_any_texts(texts, needles, gram):
    found = matching.Matcher(needles, gram)
    for text in texts:
        assert found.found(text) == {i for i, x in enumerate(needles) if x in text}


def test_texts_longer_than_a_step():
    r = random.Random(5)
    text = "".join(r.choices("abcdefgh", k=2 * matching.STEP + 999))
    edge = matching.STEP
    needles = [text[edge - 5 : edge + 9], text[edge - 300 : edge + 300], text[-3:], text[:40], "ijk", text[2 * edge - 11 : 2 * edge + 1], text[edge : edge + 12]]
    assert matching.Matcher(needles, 12).found(text) == {0, 1, 2, 3, 5, 6}


def test_many_needles_of_one_head_and_hot_texts():
    needles = [f"common beginning {i:05d}" for i in range(3000)]
    assert matching.Matcher(needles, 12).found("x common beginning 00042 common beginning 02999 common beginning") == {42, 2999}
    assert matching.Matcher(["a", "aa", "a" * 50], 12).found("a" * 100_000) == {0, 1, 2}


@pytest.mark.parametrize("pairs", [retrieval.substring_pairs, retrieval.joined_pairs])
def test_both_ways_give_the_same_pairs(spark, pairs):
    r = random.Random(9)
    hays = [(i, "".join(r.choices("abc ", k=r.randrange(60)))) for i in range(80)] + [(90, None), (91, "")]
    needles = [(f"n{i}", "".join(r.choices("abc ", k=r.randrange(1, 16)))) for i in range(60)] + [("again", "ab"), ("more", "ab")]
    found = pairs(spark.createDataFrame(hays, "hay_id long, hay string"), spark.createDataFrame(needles, "needle_id string, needle string"))
    assert sorted(map(tuple, found.collect())) == sorted((h, n) for h, x in hays for n, y in needles if x and y in x)


def test_no_needles(spark):
    hays = spark.createDataFrame([(1, "a")], "hay_id long, hay string")
    assert retrieval.substring_pairs(hays, spark.createDataFrame([(1, "")], "needle_id long, needle string")).count() == 0


def test_leaks_take_one_python_worker_a_task(spark):
    from tallyspark.operators import retrieval

    public = spark.createDataFrame([(1, "the se_cret Word"), (2, None), (3, "")], "public_id long, text string")
    private = spark.createDataFrame([(7, "SECRET-word"), (8, ""), (9, None)], "private_id long, value string")
    out = retrieval.leaks(public, private, "text", "value")
    assert [tuple(r) for r in out.collect()] == [(1, 7)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
