"""Importance resampling against a plain version: features one by one, a full sort for the ranks."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest
from cases import SCHEMA, documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspark.llm import queries, resample
from tallyspark.llm.common import materialise

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets(text: str | None, n: int = 3, of: int = 10_000) -> list[int]:
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % of for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs: list[tuple], target: list[str | None], how: resample.Resampling) -> list[tuple]:
    source, wanted = [0] * how.buckets, [0] * how.buckets
    each = [buckets(t, how.n, how.buckets) for _, t in docs]
    for own in each:
        for b in own:
            source[b] += 1
    for t in target:
        for b in buckets(t, how.n, how.buckets):
            wanted[b] += 1
    s_all, t_all, b_all = sum(source), sum(wanted), how.buckets
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + b_all) / ((s + 1) * (t_all + b_all)))) for s, t in zip(source, wanted)]
    out = []
    for (doc, text), own in zip(docs, each):
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([doc, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= how.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: how.percent * len(able) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


def test_features_of_odd_texts(spark):
    texts = ["A b\x00c d-e_f", "éÉ ß x", "w" * 62 + " a " + "v" * 63 + " b c " + "u" * 5000 + " d", "", "one", " \t\n", "1 2 3 4", "x" * 64 + " y", "Ａ ﷺ \U0001f600a b"]
    for how in (resample.Resampling(), resample.Resampling(n=1), resample.Resampling(n=5, buckets=97)):
        counts, sums, left = resample.batch_runs([t.encode() for t in texts], how.n)
        assert counts.tolist() == [len(words(t)) for t in texts]
        found = sorted(int(c) % how.buckets for k, own in enumerate(sums) for c, x in zip(own, left) if x > k)
        assert found == sorted(b for t in texts for b in buckets(t, how.n, how.buckets))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1é- \n漢"), max_size=60), max_size=6))
def test_features_of_any_texts(texts):
    _, sums, left = resample.batch_runs([t.encode() for t in texts], 3)
    assert sorted(int(c) % 10_000 for k, own in enumerate(sums) for c, x in zip(own, left) if x > k) == sorted(b for t in texts for b in buckets(t))


@pytest.mark.parametrize("how", [resample.Resampling(percent=30), resample.Resampling(n=2, buckets=64, seed=7, percent=100, least_words=1), resample.Resampling()])
def test_resampling_is_that_of_a_full_sort(spark, how):
    target = [prose(52, 70), prose(1, 40), None, "", "same line here"]
    found = resample.resample(documents(spark, clash=True).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), how)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain([(i, t) for i, t, *_ in rows()], target, how), key=repr)


def test_ties_go_to_the_smaller_id_and_ids_may_lack(spark):
    scored = [(i, 30, 7 if i % 3 else 5) for i in range(100, 0, -1)] + [(None, 30, 7), (500, 3, 99), (501, 30, -(10**12))]
    table = materialise(spark.createDataFrame(scored, "doc_id long, n_words long, score long"), "scored")
    got = resample.draw(table, resample.Resampling(percent=40)).collect()
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[2], r[0] is None, r[0] or 0))
    assert {r.doc_id: r["rank"] for r in got if r["rank"]} == {r[0]: i + 1 for i, r in enumerate(able[: 40 * len(able) // 100])}
    assert len(got) == len(scored)


def test_empty_tables(spark):
    none = empty(spark)
    assert resample.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA)
    assert [tuple(r) for r in resample.resample(one, none).collect()] == plain([(1, "a b")], [], resample.Resampling())
    assert resample.resample(none, one).count() == 0


def test_query_over_whole_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    want = [(r[0], *r[2:]) for r in plain(docs, target, resample.Resampling())]
    assert sorted(map(repr, map(tuple, queries.op13_importance_resample(spark, at).collect()))) == sorted(map(repr, want))
