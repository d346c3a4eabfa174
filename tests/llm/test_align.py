"""Alignment against a plain version: both libraries on whole texts, overlaps pair by pair."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from cases import SCHEMA, documents, empty, rows
from tallyspark.llm import align, packing, queries


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(packing.default_vocabulary().json)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.piece_model())


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in printable]
    return {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(rest)}


ALPHABET = byte_alphabet()


def spans(ids: list[int], names: list[bytes]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for i, x in zip(ids, names):
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(docs: list[tuple], both) -> list[tuple]:
    a_side, b_side = both
    each, holds = [], Counter()
    for doc, text in docs:
        a_ids = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_side.encode(text) if text else []
        a_bytes = [bytes(ALPHABET[c] for c in a_side.id_to_token(i)) for i in a_ids]
        b_names = [b_side.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x..>", x) else x.replace("▁", " ").encode() for x in b_names]
        if not text or b"".join(a_bytes) != b" " + text.encode() or b"".join(b_bytes) != b" " + text.encode():
            each.append((doc, None))
            continue
        a, b = spans(a_ids, a_bytes), spans(b_ids, b_bytes)
        links, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, m, n = [], 0, 0
        for end in ends:
            own: tuple[list, list] = ([], [])
            while m < len(a) and a[m][2] <= end:
                own[0].append(a[m][0])
                m += 1
            while n < len(b) and b[n][2] <= end:
                own[1].append(b[n][0])
                n += 1
            groups.append("|".join(",".join(map(str, x)) for x in own))
        holds.update(set(links))
        each.append((doc, (len(a), len(b), groups, links)))
    top: dict[int, int] = {}
    for (i, _), n in holds.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc, found in each:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((doc, n_a, n_b, len(groups), len(links), sum(holds[x] == top[x[0]] for x in links), sum(holds[x] for x in links), digest))
    return out


ORDER = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(df) -> list:
    return sorted((tuple(r) for r in df.select(*ORDER).collect()), key=repr)


def odd_texts() -> list[str]:
    r = random.Random(11)
    marks = ["a", "Bc", " ", "  ", "\n", "\t", " \n", "\n ", "é", "漢字", "\U0001f600", "'s", "12", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "_", " ", " ", "\x00", "\x1c", "\u0085", "ﷺ", "x" * 70, "▁", "word", "The", "."]
    return [" lead", "trail ", " ", "  ", "\n", "a  b", "a \nb", "a\n b", " a b ", "é é", "ﬁ ½", *("".join(r.choices(marks, k=r.randrange(1, 30))) for _ in range(250)), *(" ".join(r.choices(marks, k=12)) for _ in range(100))]


def test_odd_texts(spark, both):
    docs = list(enumerate(odd_texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs, both)
    assert any(r[1] == 0 for r in want) and sum(r[1] > 0 for r in want) > 100
    assert told(align.align(df)) == sorted(want, key=repr)


@pytest.mark.parametrize("sides", [align.Sides(), align.Sides(block_bytes=3000, block_rows=3)])
def test_the_cases_in_any_blocks(spark, both, sides):
    found = align.align(documents(spark, clash=True).repartition(3), sides)
    assert told(found) == sorted(plain([(i, t) for i, t, *_ in rows()], both), key=repr)


def test_query_over_the_whole_table(spark, both):
    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert told(queries.op11_token_alignment(spark, at)) == sorted(plain(docs, both), key=repr)


def test_empty_and_only_unusable_texts(spark):
    assert align.align(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (None, ""), (3, "a▁b")], "doc_id long, text string")
    assert told(align.align(none)) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 3)], key=repr)


def test_very_long_runs(spark, both):
    docs = [(1, " " * 300_000), (2, "x" * 100_000), (3, "\n" * 50_000 + "a"), (4, "é" * 20_000 + " b"), (5, "ab cd " * 50_000)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    assert told(align.align(df)) == sorted(plain(docs, both), key=repr)
