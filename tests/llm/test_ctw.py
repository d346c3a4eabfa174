"""Context-tree weighting against a recursive tree of plain Python numbers."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import cache
from math import exp, lgamma, log, log10, pi

import pytest
from cases import SCHEMA, documents, empty, prose, rows, told
from pyspark.sql import functions as F
from tallyspark.llm import ctw

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def coded(text: str | None, depth: int):
    """(context, byte) of each coded byte and the end."""
    raw = b"\xff" * depth + (text or "").encode() + b"\xff"
    return [(raw[i - depth : i], raw[i]) for i in range(depth, len(raw))]


def decisions(byte: int):
    """(leading bits after a 1, bit) of a byte's eight decisions."""
    return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]


class Trees:
    def __init__(self, texts: list[str | None], depth: int):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.children: dict = defaultdict(set)
        for text in texts:
            for context, byte in coded(text, depth):
                for node, bit in decisions(byte):
                    for d in range(depth + 1):
                        self.n[node, context[depth - d :]][bit] += 1
                        if d:
                            self.children[node, context[depth - d + 1 :]].add((node, context[depth - d :]))
        self.weighted = cache(self.weighted)

    def kt(self, key) -> float:
        a, b = self.n.get(key, (0, 0))
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def weighted(self, key) -> float:
        if len(key[1]) == self.depth:
            return self.kt(key)
        own, below = self.kt(key), sum(self.weighted(c) for c in self.children.get(key, ()))
        top = max(own, below)
        return top + log((exp(own - top) + exp(below - top)) / 2)

    def one(self, node: int, context: bytes) -> float:
        """Probability of a one: estimates of all depths mixed by posterior shares."""
        rest, out = 1.0, 0.0
        for d in range(self.depth + 1):
            key = (node, context[self.depth - d :])
            a, b = self.n.get(key, (0, 0))
            share = 1.0 if d == self.depth else exp(self.kt(key) + log(0.5) - self.weighted(key))
            out += rest * share * (b + 0.5) / (a + b + 1)
            rest *= 1 - share
        return out

    def score(self, text: str | None) -> float:
        total = 0.0
        for context, byte in coded(text, self.depth):
            for node, bit in decisions(byte):
                p = self.one(node, context)
                total += log10(p if bit else 1 - p)
        return total


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("limits", [ctw.Limits(), ctw.Limits(words=3, grams=20), ctw.Limits(words=0, grams=0)])
def test_scores_are_those_of_the_trees(spark, limits):
    docs = [(i, t, None, None, None) for i, t in enumerate([None, "", "abab abab", "abba é Abab", "the cat sat on the mat", "zzz", prose(1, 30, 8), prose(2, 30, 8), "the THE mat"])]
    learnt = {0, 2, 4, 6}
    trees = Trees([docs[i][1] for i in sorted(learnt)], 4)
    counts = Counter(w for i in learnt for w in [*WORD.findall(lower(docs[i][1])), ""])
    total, scale = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    found = ctw.score_texts(spark.createDataFrame(docs, SCHEMA), F.col("doc_id").isin(*learnt), limits=limits)
    assert found.count() == len(docs)
    for r in found.collect():
        words = [*WORD.findall(lower(docs[r.doc_id][1])), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / scale) for w in words), rel=1e-9)
        assert r.score == pytest.approx(trees.score(docs[r.doc_id][1]), rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score / log10(2) / (len((docs[r.doc_id][1] or "").encode()) + 1), rel=1e-9)


@pytest.mark.parametrize("depth", [1, 6])
def test_other_depths_and_texts_with_zero_bytes(spark, depth):
    docs = [(i, t, None, None, None) for i, t in enumerate(["ab\0ab", "\0\0", "abab" * 5 + "\0", "x" * 200 + " ab", "ab " + "x" * 200])]
    trees = Trees([docs[i][1] for i in (0, 2, 3)], depth)
    for r in ctw.score_texts(spark.createDataFrame(docs, SCHEMA), F.col("doc_id").isin(0, 2, 3), depth=depth).collect():
        assert r.score == pytest.approx(trees.score(docs[r.doc_id][1]), rel=1e-6)
        assert r.n_known == (1 if r.doc_id == 1 else r.n_tokens - (r.doc_id == 0) * 0)


def test_learnt_prose_costs_fewer_bits(spark):
    docs = spark.createDataFrame([(i, prose(i, 200, 60), None, None, None) for i in range(20)] + [(100, "qzj xvk " * 50, None, None, None)], SCHEMA)
    found = {r.doc_id: r.bits_per_byte for r in ctw.score_texts(docs, F.col("doc_id") < 15).collect()}
    assert all(found[i] < 3 < found[100] for i in range(15, 20))


def test_table(spark):
    train = F.col("doc_id") % 2 == 0
    found = ctw.score_texts(documents(spark), train)
    assert found.count() == len(rows())
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in told(found)] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in told(ctw.score_texts(documents(spark, clash=True), train))]
    assert ctw.score_texts(empty(spark), train).count() == 0
    even = ctw.score_texts(documents(spark), F.lit(None).cast("boolean")).collect()
    assert {r.train_tokens for r in even} == {0} and {r.base_score for r in even} == {0.0}
    assert all(r.bits_per_byte == pytest.approx(8) for r in even)
