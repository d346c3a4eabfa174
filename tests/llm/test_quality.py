"""Quality rules against a plain count over lists of words."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from cases import documents, empty, prose, rows, told
from tallyspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = quality.RepetitionRules()


def plain(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup_lines += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)

    def inside(n: int, later: bool) -> set[int]:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, out = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if g in seen if later else counts[g] > 1:
                out |= set(range(i, i + n))
            seen.add(g)
        return out

    symbols = sum(c in "#*$%&|<>" for c in text)
    repeat = len(inside(3, False))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    good = not failed and dup_chars <= RULES.line_limit * chars
    good = good and all(sum(len(words[j]) for j in inside(n, True)) <= most * chars for n, most in RULES.ngram_limits.items())
    return len(words), chars, symbols, dup_lines, repeat, failed, good


def test_measures_are_the_plain_counts():
    r = random.Random(4)
    texts = [t for _, t, *_ in rows() if t is None or len(t) < 20_000]
    texts += [" ".join(r.choices(["ä", "b#", "c", "dd\n", "e\n\n"], k=r.randrange(120))) for _ in range(150)]
    texts += [prose(i, 40) + "\n" + prose(i, 40) + "\n" + prose(i + 1, 30 + i) for i in range(20)]
    for t in texts:
        got = quality.measure(None if t is None else t.encode(), RULES)
        assert got[:7] == plain(t), t


def test_many_words_still_have_exact_trigram_keys(monkeypatch):
    words = [f"v{i}" for i in range(3000)] * 2
    want = quality.measure(" ".join(words).encode(), RULES)
    monkeypatch.setattr(quality, "word_ids", lambda w, f=quality.word_ids: f(w) + (1 << 20))
    assert quality.measure(" ".join(words).encode(), RULES)[4] == want[4] == 6000


def test_limits_of_single_words_and_pairs_are_errors():
    with pytest.raises(ValueError):
        quality.RepetitionRules(ngram_limits={2: 0.1})
    assert quality.measure(b"a b c " * 40, quality.RepetitionRules(ngram_limits={3: 0.1}, repeat_percent=100))[8] == 117 / 120


def test_table(spark):
    found = quality.score_repetition(documents(spark))
    assert told(found) == told(quality.score_repetition(documents(spark, clash=True)))
    assert found.count() == len(rows())
    by_id = {r.doc_id: r for r in found.collect()}
    assert not by_id[0].kept and by_id[0].n_words == 0
    assert by_id[5].kept and not by_id[10].kept
    assert quality.score_repetition(empty(spark)).count() == 0


def test_keep_good_keeps_columns_and_clean_rows(spark):
    docs = documents(spark, clash=True)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.score_repetition(documents(spark)).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert kept.where("doc_id = 12").count() == 2
    assert quality.keep_good(empty(spark)).count() == 0


def judged(text: str, **limits) -> bool:
    return quality.measure(text.encode(), quality.RepetitionRules(**limits))[6]


def test_each_kind_of_limit_decides_by_itself():
    off = {"line_limit": 1.0}
    passage = prose(7, 60)
    assert judged(prose(1, 150) + " " + passage) and judged(prose(1, 150))
    twice = " ".join([prose(1, 100), passage, prose(2, 100), passage])  # a fifth of the words, on one line
    assert not judged(twice) and not judged(twice, **off) and judged(twice, ngram_limits={})
    for n in range(5, 11):
        assert not judged(twice, ngram_limits={n: 0.15}, **off)
    lines = "\n".join([prose(3, 100), *(f"four words a line\nk{i} {prose(i, 1)}" for i in range(20))])
    assert not judged(lines, ngram_limits={}) and judged(lines, ngram_limits={}, **off)
    short = "\n".join([prose(4, 12), prose(5, 200), prose(4, 12)])  # one short line again
    assert judged(short)
    odd = " ".join(f"{w}###" for w in prose(6, 100).split())
    assert judged(odd) and not judged(odd, symbol_limit=0.5)


def test_limits_reject_texts_of_the_tables_that_the_base_rule_passes(spark):
    found = quality.score_repetition(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed")
    assert found.where("not kept and ngram_share > 0.1").count() > 0 and found.where("not kept and line_share > 0.15").count() > 0
    assert found.where("kept").count() > 0.99 * found.count()
