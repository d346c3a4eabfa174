"""Packing: token pieces as the tokenizer library gives them, and gapless sequences."""

from __future__ import annotations

import random
from math import ceil

import numpy as np
import pytest
from cases import SCHEMA, documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspark.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary().json)


def test_ids_are_those_of_the_tokenizer(tokenizer):
    r = random.Random(8)
    marks = ["a", "B", " ", "  ", "\n", "\t", "é", "漢", "\U0001f600", "'s", "12", "<|endoftext|>", "_", " ", "\x00", "ﷺ"]
    own = packing.encoder(packing.default_vocabulary())
    for t in ["", "x" * 5000, *("".join(r.choices(marks, k=r.randrange(40))) for _ in range(300))]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_very_long_runs_of_one_kind_of_character(spark, tokenizer):
    """The faster library's pattern fails on the first ones."""
    marks = random.Random(3)
    texts = [" " * 1_000_000, "\n" * 1_000_000, "word" + "\t\n" * 500_000 + "word", "a" * 1_000_000, "\u2003é漢" * 100_000, "".join(marks.choices(" \n\u2003x漢é!1", k=400_000))]
    own = packing.encoder(packing.default_vocabulary())
    for t in texts:
        assert np.array_equal(np.frombuffer(own.ids(t), "<u4"), np.array(tokenizer.encode(t, add_special_tokens=False).ids)), t[:5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lengths = {r.doc_id: r.n for r in packing.token_pieces(df).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert lengths == {i: len(own.ids(t)) // 4 + 1 for i, t in enumerate(texts)}


def test_ids_of_whole_documents_are_those_of_the_tokenizer(spark, tokenizer):
    own = packing.encoder(packing.default_vocabulary())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert np.frombuffer(own.ids(r.text or ""), "<u4").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_copies_of_a_document_are_told_apart(spark):
    df = spark.createDataFrame([(1, prose(1, 200)), (1, prose(1, 200)), (2, "a"), (None, "b"), (None, "c")], "doc_id long, text string")
    found = packing.number_copies(packing.pack(packing.token_pieces(df, capacity=64).drop("ids"), 64)).collect()
    assert len({(r.doc_id, r.copy, r.piece) for r in found if r.doc_id}) == sum(r.doc_id is not None for r in found)
    assert {(r.doc_id, r.copy) for r in found} == {(1, 0), (1, 1), (2, 0), (None, 0)}


def test_pieces_join_to_the_documents(spark, tokenizer):
    asked = [(i, t) for i, t, *_ in rows() if i != 12]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in asked], SCHEMA)
    whole: dict = {}
    for r in sorted(packing.token_pieces(df, capacity=50).collect(), key=lambda r: (r.doc_id, r.piece)):
        before = whole.setdefault(r.doc_id, [])
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == len(before) and r.length == len(ids) <= 50 and (r.piece == 0 or r.length == 50)
        before += ids
    assert whole == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in asked}


def test_the_faster_library_has_a_special_token_to_look_for():
    """Without one it looks for the empty pattern at every place of a text. Its id is no rank's."""
    own = packing.encoder(packing.default_vocabulary())
    assert own.plain.special_tokens_set == {packing.SPECIAL}
    assert own.plain.encode_single_token(packing.SPECIAL) == own.whole.token_to_id(packing.SPECIAL)
    for text in ("", "a b", "\n é 字 \U0001f600", "x" * 5000, "<|endoftext|", f"a {packing.SPECIAL} b", f"{packing.SPECIAL}" * 3):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 60)))
def test_plans_fill_bins_without_gaps(counts):
    placed, bins = packing.plan_bins(counts, 24)
    inside: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, list[int]] = {}
    for length, lo, hi, a_bin, first, filled in placed:
        for k in range(hi - lo):
            ranks.setdefault(length, []).append(lo + k)
            inside.setdefault(first + k // a_bin, []).append((filled + k % a_bin * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items() if n}
    assert sorted(inside) == list(range(bins))
    for spots in inside.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 24
    least = ceil(sum(x * n for x, n in counts.items()) / 24)
    assert bins <= 1.5 * max(least, sum(n for x, n in counts.items() if x > 12)) + 1


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_as_many_bins_as_best_fit_document_by_document():
    r = random.Random(1)
    for _ in range(40):
        lengths = [min(100, int(r.expovariate(1 / 25)) + 1) for _ in range(400)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        assert packing.plan_bins(counts, 100)[1] <= plain_best_fit(lengths, 100) + 1


def test_table(spark):
    packed = packing.pack(packing.token_pieces(documents(spark, clash=True), capacity=64).drop("ids"), 64)
    got = packed.collect()
    want = packing.token_pieces(documents(spark), capacity=64)
    assert len(got) == want.count() and sum(r.length for r in got) == want.agg({"length": "sum"}).first()[0]
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64
    assert packing.pack(packing.token_pieces(empty(spark))).count() == 0


def test_bad_lengths_and_names_are_errors(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 2000)], "doc_id long, piece int, length long"))
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 2, 3)], "doc_id long, piece int, length long, offset long"))
