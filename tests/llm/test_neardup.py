"""Near-duplicates against all pairs of exact shingle sets."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
from cases import SCHEMA, documents, edited, empty, prose, rows, told
from tallyspark.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, n: int) -> set[tuple]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if len(words) >= n else {tuple(words)}


def plain(docs: list[tuple], b: neardup.Banding) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets: dict[int, set] = {i: shingles(t, b.words) for i, t, *_ in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= b.percent * len(sets[i] | sets[j]):
            a, c = sorted((find(i), find(j)))
            root[c] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, docs: list[tuple], b: neardup.Banding):
    found = neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), b)
    want = plain(docs, b)
    for r in found.collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.component_id == r.doc_id)


def chain(first: int, length: int) -> list[tuple]:
    """Texts that each link with the next one only."""
    text, out = prose(first, 200), []
    for i in range(length):
        out.append((first + i, text, None, None, None))
        words = text.split()
        at = (i * 17) % 180
        words[at : at + 8] = [f"c{i}y{j}" for j in range(8)]
        text = " ".join(words)
    return out


@pytest.mark.parametrize("b", [neardup.Banding(words=3, percent=85), neardup.Banding()])
def test_components_are_those_of_all_pairs(spark, b):
    docs = rows() + chain(1000, 25)
    for i in range(30):
        base = prose(300 + i, 80 + 10 * i)
        docs += [(2000 + 10 * i + k, edited(base, 10 + 12 * k, k), None, None, None) for k in range(5)]
    check(spark, docs, b)


def test_large_groups_are_cut_into_chunks_without_losing_links(spark):
    b = neardup.Banding()
    base = prose(9, 120)
    docs = [(i, edited(base, 40 + i % 50, i), None, None, None) for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA)
    found = neardup.signatures(df, b)
    placed = neardup.places(found, neardup.clusters(found, b), b, docs_a_chunk=7)
    groups = placed.selectExpr("node", "explode(slots) AS s").groupBy("s.group").count()
    assert groups.count() > 5 and groups.agg({"count": "max"}).first()[0] <= 40
    sets = {neardup.node_of(s): set(s.tolist()) for s in (neardup.shingles(t.encode(), b.words, neardup.Words()) for _, t, *_ in docs)}
    want = {frozenset(p) for p in combinations(sets, 2) if 100 * len(sets[p[0]] & sets[p[1]]) >= b.percent * len(sets[p[0]] | sets[p[1]])}
    got = {frozenset(map(bytes, r)) for r in neardup.links(df, placed, b).collect()}
    assert got <= want

    def parts(pairs):
        root = {n: n for n in sets}
        for pair in pairs:
            u, v = pair
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            root[u] = v
        out: dict = {}
        for n in sets:
            at = n
            while root[at] != at:
                at = root[at]
            out.setdefault(at, set()).add(n)
        return {frozenset(x) for x in out.values()}

    assert parts(got) == parts(want)


def test_sub_keys_meet_as_often_as_the_miss_allows():
    b = neardup.Banding(words=3, percent=85)
    r = np.random.default_rng(3)
    lost = 0
    by = neardup.multipliers(b)
    for _ in range(200):
        both, own = neardup.mix(r.integers(1, 1 << 62, 170).astype(np.uint64)), neardup.mix(r.integers(1, 1 << 62, 30).astype(np.uint64))
        x, y = (np.unique(np.concatenate((both, o))) for o in (own[:15], own[15:]))
        same = neardup.sub_keys(x, by, b) == neardup.sub_keys(y, by, b)
        lost += not (same[: b.side].any() and same[b.side :].any())
    assert lost <= 2


def test_keep_one(spark):
    docs = documents(spark, clash=True)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    want = plain(rows(), neardup.Banding())
    assert got == sorted(i for i, (_, c) in want.items() if i == c)
    assert neardup.keep_one(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, None, None, None, None)], SCHEMA)
    assert neardup.keep_one(nulls).count() == 2
    assert told(neardup.near_duplicates(docs)) == told(neardup.near_duplicates(documents(spark)))
