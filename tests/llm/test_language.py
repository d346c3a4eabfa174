"""Language mixtures: held-out accuracy, and proportions of texts joined from two languages."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from cases import SCHEMA, documents, empty, rows, told
from tallyspark.llm import language


def speak(lang: int, seed: int, n: int) -> str:
    """Words over syllables of a language's own frequency."""
    syllables = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
    order = random.Random(lang)
    weight = [order.random() ** 4 for _ in syllables]
    r = random.Random(seed)
    return " ".join("".join(r.choices(syllables, weight, k=r.randint(1, 3))) for _ in range(n))


def corpus(spark, n: int = 60):
    return spark.createDataFrame([(i, speak(i % 4, i, 80), f"l{i % 4}", None, None) for i in range(n)], SCHEMA)


def test_held_out_accuracy_and_mixtures(spark):
    model = language.train(corpus(spark))
    assert model.names == ("l0", "l1", "l2", "l3")
    asked = [(1000 + i, speak(i % 4, 5000 + i, 30), None, None, None) for i in range(80)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(asked, SCHEMA), model).collect()}
    right = [found[1000 + i].lang_pred == f"l{i % 4}" for i in range(80)]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in found.values())
    for share in (0.3, 0.5, 0.7):
        text = speak(0, 77, int(600 * share)) + " " + speak(2, 78, int(600 * (1 - share)))
        lang, score, parts = language.infer(text, model, 8.0)
        assert set(parts) == {"l0", "l2"} and abs(parts["l0"] - share) < 0.12
        assert parts[lang] == score == max(parts.values()) and abs(sum(parts.values()) - 1) < 1e-6
    assert set(language.infer(speak(1, 99, 300), model, 8.0)[2]) == {"l1"}


def test_em_reaches_the_best_proportion_of_a_grid():
    r = np.random.default_rng(1)
    p = r.random((40, 2))
    n = r.integers(1, 9, 40)
    weight, value, bound = language.mixture(p, n)
    grid = np.linspace(0, 1, 2001)
    best = max(float(n @ np.log(p @ np.array([g, 1 - g]))) for g in grid)
    assert value >= best - 1e-2 and bound >= best - 1e-9 and bound - value < 0.5
    assert language.mixture(p, n, enough=best + 5.0)[2] >= best - 1e-9


def test_language_sets_are_the_best_of_all_sets(spark):
    """Against every subset of six languages, among them near copies of one another."""
    r = np.random.default_rng(3)
    found = mixed = 0
    for trial in range(60):
        base = r.dirichlet(np.ones(80) * 0.3, 4)
        tables = np.vstack([base, 0.9 * base[0] + 0.1 * base[1], 0.8 * base[2] + 0.2 * base[3]]) + 1e-4
        tables /= tables.sum(1, keepdims=True)
        share = r.dirichlet(np.ones(6) * 0.3)
        n = r.multinomial(int(r.integers(30, 900)), share @ tables)
        p, n = tables[:, n > 0].T, n[n > 0]
        cost = float(r.choice([1.0, 4.0, 20.0]))
        worth = {s: language.mixture(p[:, list(s)], n, rounds=3000)[1] - cost * (len(s) - 1) for k in range(1, 7) for s in itertools.combinations(range(6), k)}
        alone = {k: worth[(k,)] for k in range(6)}
        best = max(alone, key=alone.get)
        chosen, weight = language.choose(p, n, best, alone[best], cost)
        assert abs(weight.sum() - 1) < 1e-6
        found += worth[tuple(sorted(chosen))] >= max(worth.values()) - 0.02
        mixed += len(chosen) > 1
    assert found >= 59 and mixed > 20


def test_hundreds_of_labels_are_all_learned(spark):
    rows_of = [(i, f"{chr(0x4E00 + i)}{chr(0x4E01 + i)} {chr(0x4E00 + i)}", f"n{i:03d}", None, None) for i in range(300)] + [(1000, "aaa", "often", None, None)] * 50
    df = spark.createDataFrame(rows_of, SCHEMA)
    model = language.train(df, buckets=4096)
    assert len(model.names) == 301 and "n299" in model.names
    told_ = {r.doc_id: r.lang_pred for r in language.identify(df.where("doc_id % 60 = 7"), model).collect()}
    assert told_ == {i: f"n{i:03d}" for i in range(7, 300, 60)}
    with pytest.raises(ValueError):
        language.train(df, max_languages=300)


def test_counts_are_those_of_all_labelled_rows(spark):
    docs = documents(spark)
    model = language.train(docs, buckets=512)
    want = np.zeros((2, 512))
    for _, text, lang, *_ in rows():
        if text is not None and lang is not None and (f := language.features(text, 512)) is not None:
            want["ab".index(lang[0])] += np.bincount(f, minlength=512)
    want += 0.5
    assert np.allclose(model.log_p, np.log(want / want.sum(1, keepdims=True)), atol=1e-5)


def test_table(spark):
    model = language.train(corpus(spark))
    found = language.identify(documents(spark), model)
    assert found.count() == len(rows())
    by_id = {r.doc_id: r for r in found.collect()}
    assert {by_id[i].lang_pred for i in (0, 1, 2)} == {"und"} and by_id[0].score == 0.0
    assert by_id[5].lang_pred == by_id[6].lang_pred
    plain = told(found.select("doc_id", "lang_pred", "score"))
    assert plain == told(language.identify(documents(spark, clash=True), model).select("doc_id", "lang_pred", "score"))
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.identify(documents(spark), nothing).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(documents(spark), language.train(documents(spark).where("lang = 'aa'"))).collect()} == {"und", "aa"}
