"""Files of the asymmetric numeral system: exact round trips, order, checksums and reads from the middle."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from cases import SCHEMA, documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspark.llm import packing, queries, rans
from tallyspark.llm.common import materialise

SMALL = rans.Shape(block=700, lanes=4, steps=16, file=5000, least_file=300)


def counts(ids: np.ndarray) -> dict[int, int]:
    return {int(i): int(n) for i, n in zip(*np.unique(ids, return_counts=True))}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 3000), st.integers(0, 2**32 - 1))
def test_round_trip_and_spans_of_a_segment(n, symbols, seed):
    r = np.random.default_rng(seed)
    ids = np.minimum(r.geometric(min(0.9, 20 / symbols), n) - 1, symbols - 1).astype("<u4") * 7
    table = rans.table_of(counts(ids))
    assert int(table.freq.sum()) == (1 << 20 if n else 0)
    segment = rans.encode_segment([n // 3, n - n // 3], ids, table, rans.Shape(block=1500, lanes=3, steps=64))
    lengths, found = rans.decode_segment(segment, table)
    assert lengths.tolist() == [n // 3, n - n // 3] and np.array_equal(found, ids)
    a, b = sorted(r.integers(0, n + 1, 2).tolist())
    assert np.array_equal(rans.decode_segment(segment, table, a, b)[1], ids[a:b])


def test_size_is_near_the_entropy():
    r = np.random.default_rng(2)
    ids = np.minimum(r.geometric(0.01, 300_000), 5000).astype("<u4")
    p = np.array(list(counts(ids).values())) / len(ids)
    bits = 8 * len(rans.encode_segment([len(ids)], ids, rans.table_of(counts(ids)))) / len(ids)
    assert bits < 1.04 * -(p * np.log2(p)).sum()


def test_rare_ids_keep_a_place_and_too_many_are_an_error():
    table = rans.table_of({1: 10**12, **{i: 1 for i in range(2, 1000)}}, 12)
    assert int(table.freq.sum()) == 4096 and table.freq.min() == 1
    assert rans.table_of({5: 3}).freq.tolist() == [1 << 20]
    with pytest.raises(ValueError):
        rans.table_of({i: 1 for i in range(5000)}, 12)


def test_changed_bytes_other_tables_and_unknown_ids_are_errors():
    ids = np.arange(2000, dtype="<u4") % 50
    table = rans.table_of(counts(ids))
    segment = rans.encode_segment([2000], ids, table, SMALL)
    for at in (0, 9, 40, len(segment) // 2, len(segment) - 1):
        with pytest.raises(ValueError):
            rans.decode_segment(segment[:at] + bytes([segment[at] ^ 1]) + segment[at + 1 :], table)
    with pytest.raises(ValueError):
        rans.decode_segment(segment, rans.table_of({1: 1, 2: 1}))
    block = rans.encode_block(table.place[ids], table, SMALL)
    broken = bytearray(block)
    broken[-2] ^= 4  # in the words: the checkpoint's own checksum tells
    with pytest.raises((ValueError, IndexError)):
        rans.decode_block(memoryview(bytes(broken)), 0, table)
    for odd in ([60], [10**6]):
        with pytest.raises(ValueError):
            rans.encode_segment([1], np.array(odd, "<u4"), table)


def plain(table: list[tuple]) -> list[tuple]:
    """Every document's ids by the library, in ascending doc_id, nulls first."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary().json)
    out, start = [], 0
    for doc, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("shape", "narrow"), [(rans.Shape(), True), (SMALL, True), (SMALL, False)])
def test_files_hold_every_document_in_order(spark, tmp_path, shape, narrow):
    docs = documents(spark, clash=True).repartition(3)
    at = rans.store(docs, str(tmp_path / "tokens"), narrow, shape=shape)
    found = rans.read_tokens(spark, at).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()
    assert sorted(map(tuple, found)) == sorted(plain([(i, t) for i, t, *_ in rows()]))
    assert spark.read.parquet(f"{at}/segments").select("part").distinct().count() > (shape == SMALL)
    one = rans.document_ids(spark, at, [9, 4]).collect()
    whole = {r.doc_id: bytes(r.ids) for r in rans.read_tokens(spark, at).collect()}
    assert {r.doc_id: bytes(r.ids) for r in one} == {9: whole[9], 4: whole[4]}


def test_rows_without_id_and_copies_are_told_apart(spark, tmp_path):
    table = [(None, "b c"), (None, "a"), (7, "same"), (7, "same"), (3, None), (1, "<|endoftext|> x"), (2, prose(4, 3000))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in table], SCHEMA)
    at = rans.store(docs, str(tmp_path / "tokens"), shape=SMALL)
    found = rans.read_tokens(spark, at).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()
    want = plain(table)
    assert sorted(r[1:3] for r in found)[-1] == want[-1][1:3] and {tuple(r) for r in found if r[0]} == {r for r in want if r[0]}
    assert sum(r[0] is None for r in found) == 2 and len({r[1] for r in found}) == len(table)


def test_empty_table(spark, tmp_path):
    at = rans.store(empty(spark), str(tmp_path / "tokens"))
    assert rans.read_tokens(spark, at).count() == 0


def test_text_ids_as_keys(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z"), (None, "w")], "doc_id string, text string")
    at = rans.store(docs, str(tmp_path / "tokens"))
    assert [r.doc_id for r in rans.read_tokens(spark, at).orderBy("start").collect()] == [None, "a", "b"]


def test_query_over_the_whole_table(spark):
    found = queries.op12_rans_tokens(spark, "/root/testdata/sf0.001").collect()
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, found)) == sorted(plain(table))


def test_counts_of_ids_are_those_of_all_rows(spark):
    tokens = materialise(rans.token_ids(documents(spark)), "ids")
    want: dict[int, int] = {}
    for r in tokens.where("counts IS NULL").collect():
        for i in np.frombuffer(bytes(r.ids), "<u2").tolist():
            want[i] = want.get(i, 0) + 1
    assert rans.id_counts(tokens) == want
