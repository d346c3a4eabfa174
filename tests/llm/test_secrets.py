"""Secret scans: fixed patterns, the decoder against all taggings, and secrets that only the field can see."""

from __future__ import annotations

import hashlib
import itertools
import random
import time

import numpy as np
from cases import SCHEMA, documents, empty, prose, rows, told
from tallyspark.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def key(r: random.Random, n: int = 24) -> str:
    return "".join(r.choices(ALPHABET, k=n))


def corpus(n: int = 300) -> list[tuple]:
    out = []
    for i in range(n):
        r = random.Random(i)
        text = prose(i, 40)
        if i % 3 == 0:
            name = r.choice(("password", "API_KEY", "secret", "apikey", "token"))
            text += f" {name} {r.choice('=:')} {r.choice(('', chr(34)))}{key(r)} " + prose(i + 1, 20)
        out.append((i, text, None, None, None))
    return out


def test_base_spans():
    def base(text):
        return [s[:3] for s in secrets.base_spans(text)]

    assert base('x password = "abcdefgh" y') == [("assign", 2, 22)]
    assert base("token:short1 api-key: longenough1") == []
    assert base("api_key:aaaaaaaa apikey=bbbbbbbb") == [("assign", 0, 16), ("assign", 17, 32)]
    assert base("AKIAABCDEFGHIJKL AKIAABC") == [("access", 0, 16)]
    assert base("é" + "0a" * 16 + "g" + "b" * 31) == [("hex", 1, 33)]
    assert base("PASSWD=" + "ab" * 16) == [("assign", 0, 39), ("hex", 7, 39)]
    assert base("secret = token = abcdefghij") == []  # the leftmost match takes "token" as its value, which is too short
    assert base("password=token=abcdefghij") == [("assign", 0, 25)]
    assert base("toKen=abcdefghij") == []


def test_viterbi_finds_the_best_of_all_taggings():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 6))
        score, step = r.normal(size=(n, 3)) * 3, r.normal(size=(3, 3))
        for closed in (False, True):

            def value(tags):
                out = step[secrets.O, tags[0]] + sum(score[i, t] for i, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:], strict=False))
                return out + (step[tags[-1], secrets.O] if closed else 0)

            best = max(itertools.product(range(3), repeat=n), key=value)
            assert secrets.viterbi(score, step, closed).tolist() == list(best)


def test_skipping_plain_tokens_changes_no_tagging(spark):
    model = secrets.fit(secrets.windows(spark.createDataFrame(corpus(), SCHEMA)))
    for _, text, *_ in corpus(60):
        tokens = secrets.TOKEN.findall(text)
        assert model.tags(tokens).tolist() == secrets.viterbi(model.emissions(tokens), model.step, False).tolist()


def test_field_finds_secrets_beside_the_patterns(spark):
    model = secrets.fit(secrets.windows(spark.createDataFrame(corpus(), SCHEMA)))
    r = random.Random(77)
    hit = wrong = 0
    for i in range(60):
        value = key(r)
        text = prose(900 + i, 30) + f' credential = "{value}" ' + prose(1900 + i, 30)
        hit += any(s[0] == "crf" and value in text[s[1] : s[2]] for s in secrets.find_spans(text, model))
        wrong += len(secrets.find_spans(prose(2900 + i, 80), model))
    assert hit >= 48 and wrong <= 2


def test_likelihood_and_gradients_are_those_of_all_taggings():
    texts = ['password = "abcd1234XYZ" ok', "plain words here", "token:aaaaaaaa9 x", "one"]
    s = secrets.sequences(texts, 1)
    r = np.random.default_rng(4)
    w, step = r.normal(size=(len(s.names), 3)), r.normal(size=(3, 3))

    def enumerated(w, step):
        model = secrets.Field(dict(zip(s.names, w, strict=True)), step)
        e = np.concatenate([model.emissions(secrets.TOKEN.findall(t)) for t in texts])
        total = 0.0
        for group in s.groups:
            for row in group:
                row = row[row < len(s.tag)]
                score = lambda tags, row=row: step[secrets.O, tags[0]] + sum(e[i, t] for i, t in zip(row, tags, strict=True)) + sum(step[a, b] for a, b in zip(tags, tags[1:], strict=False))
                total += score([int(x) for x in s.tag[row]]) - np.log(sum(np.exp(score(t)) for t in itertools.product(range(3), repeat=len(row))))
        return total

    value, d_w, d_step = secrets.likelihood(s, w, step)
    assert np.isclose(value, enumerated(w, step))
    for array, gradient, places in ((w, d_w, [(i, c) for i in range(0, len(w), 9) for c in range(3)]), (step, d_step, [(a, b) for a in range(3) for b in range(3)])):
        for at in places:
            moved = [array.copy(), array.copy()]
            moved[0][at] += 1e-5
            moved[1][at] -= 1e-5
            up, down = ((enumerated(m, step) if array is w else enumerated(w, m)) for m in moved)
            assert np.isclose(gradient[at], (up - down) / 2e-5, atol=1e-5)


def test_words_before_secrets_are_learned_from_windows():
    """A word that no list holds stands before secrets in training: its neighbour is then more of a secret than behind another word."""
    r = random.Random(5)
    texts = [prose(i, 20) + f" geheim token={key(r)} " + prose(i + 1, 10) for i in range(60)] + [prose(100 + i, 30) + f" nummer id={prose(i, 1)} {prose(i + 3, 9)}" for i in range(60)]
    model = secrets.fit(texts)
    odds = {}
    for word in ("geheim", "nummer", "fluss"):
        score = model.emissions(secrets.TOKEN.findall(f"ab {word} q = x9k2LmQ8 cd"))[4]
        odds[word] = score[secrets.B] - score[secrets.O]
    assert odds["geheim"] > odds["nummer"] and odds["geheim"] > odds["fluss"]


def test_a_secret_at_the_end_of_a_long_window_is_learned(spark):
    """Windows of some hundred tokens keep the tags of the last ones."""
    text = "{" + ",".join(f"'{i}'" for i in range(130)) + "} password=" + "Zq7" * 6
    s = secrets.sequences([text], 1)
    assert len(s.tag) > 300 and s.tag[-1] == secrets.B
    docs = spark.createDataFrame([(1, "[" + ",".join(f"{i}" for i in range(3000)) + "];password=" + "Zq7" * 6, None, None, None)], SCHEMA)
    assert all(secrets.base_spans(w) for w in secrets.windows(docs))


def test_parts_outside_base_spans_stay_and_time_is_linear():
    base = [("assign", 2, 6, 2, 6), ("hex", 4, 8, 4, 8), ("access", 20, 30, 20, 30)]
    text = "x" * 50
    assert [s[1:3] for s in secrets.beside([("crf", 0, 10, 0, 10), ("crf", 12, 14, 12, 14), ("crf", 15, 40, 15, 40)], secrets.joined(base), text)] == [(0, 2), (8, 10), (12, 14), (15, 20), (30, 40)]
    many = [("crf", 10 * i, 10 * i + 8, 10 * i, 10 * i + 8) for i in range(40_000)]
    held = [("hex", 10 * i + 4, 10 * i + 9, 10 * i + 4, 10 * i + 9) for i in range(40_000)]
    began = time.time()
    assert len(secrets.beside(many, held, "x" * 400_000)) == 40_000
    assert time.time() - began < 2


def test_spans_never_overlap_base_ones_and_values_go(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = secrets.fit(secrets.windows(docs))
    text = {i: t for i, t, *_ in corpus()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    for row in secrets.scan(docs, model).collect():
        spans = [(s.kind, s.start, s.end, s.value_start, s.value_end) for s in row.spans]
        base = secrets.base_spans(text[row.doc_id])
        assert [s for s in spans if s[0] != "crf"] == base
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in base).encode()).hexdigest()
        assert all(s[2] <= b[1] or s[1] >= b[2] for s in spans if s[0] == "crf" for b in base)
        for s in spans:
            assert text[row.doc_id][s[3] : s[4]] not in clean[row.doc_id]
        if not spans:
            assert clean[row.doc_id] == text[row.doc_id]


def test_table(spark):
    model = secrets.fit(secrets.windows(documents(spark)))
    assert model is None  # nothing to learn from
    found = secrets.scan(documents(spark), None)
    assert found.count() == len(rows()) and told(found) == told(secrets.scan(documents(spark, clash=True), None))
    docs = documents(spark, clash=True)
    assert told(secrets.redact(docs, None)) == told(docs)
    assert secrets.fit([]) is None and secrets.windows(empty(spark)) == []
    assert secrets.scan(empty(spark), None).count() == secrets.redact(empty(spark), None).count() == 0


def test_sums_in_parts_are_those_of_all_windows(monkeypatch):
    texts = [r[1] for r in corpus()][:300]
    whole = secrets.fit(texts, rounds=3)
    monkeypatch.setattr(secrets, "TOGETHER", 7)
    parts = secrets.fit(texts, rounds=3)
    assert list(whole.weights) == list(parts.weights) and np.allclose(whole.step, parts.step)
    assert all(np.allclose(whole.weights[k], parts.weights[k]) for k in whole.weights)
