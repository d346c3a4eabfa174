"""Chat formatting: exact round trips, loss spans and attachments."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F
from tallyspark.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
PARTS = f"conv_id long, turn long, role string, parts {chat.PARTS}"
MARKS = (*chat.DEFAULT.control, "~", "~0", "~1", "<|end|>", "<|text|>", "<~1|", "é", "\U0001f600", "\n", " ", "a", "<", "|", ">")


def part(kind: str, text=None, ref=None, width=None, height=None, seconds=None, pages=None) -> tuple:
    return kind, text, ref, width, height, seconds, pages


def test_any_text_comes_back(spark):
    r = random.Random(5)
    rows = [(i, t, r.choice(("user", "assistant", "system", "tool")), "".join(r.choices(MARKS, k=r.randrange(25)))) for i in range(120) for t in range(r.randrange(1, 6))]
    rows += [(500, 0, None, None), (500, 1, "assistant", ""), (501, None, "assistant", "x"), (502, 3, "user", "twice"), (502, 3, "user", "twice"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, TURNS).withColumn("parts", chat.text_parts(F.col("text"))).selectExpr("*", "1 AS no", "2 AS body", "3 AS piece")
    found = {x.conv_id: x for x in chat.digest(chat.format_chats(df)).collect()}
    conversations: dict = {}
    for c, t, role, text in rows:
        conversations.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert found.keys() == conversations.keys()
    for c, turns in conversations.items():
        turns.sort(key=lambda x: x[0])
        lost = "".join(text for _, role, text in turns if role == "assistant")
        got = found[c]
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())


def test_escaped_texts_hold_no_control_string(spark):
    r = random.Random(6)
    texts = [("".join(r.choices(MARKS, k=30)),) for _ in range(300)]
    for row in spark.createDataFrame(texts, "text string").select(chat.escaped(F.col("text")).alias("e")).collect():
        assert not any(c in row.e for c in chat.DEFAULT.control)


def test_attachments_are_placed_and_counted(spark):
    parts = [part("text", "see <|image|> "), part("image", None, "i.png", 57, 28), part("text", "then"), part("audio", None, "a.wav", None, None, 2.0), part("document", None, "d.pdf", None, None, None, 3), part("video", "x", "v"), part("image")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok"), part("image", None, "o.png", 28, 28)]), (1, 2, "user", None), (2, 0, "user", [None, part("text", None)])]
    found = {x.conv_id: x for x in chat.format_chats(spark.createDataFrame(rows, PARTS)).collect()}
    one = found[1]
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in one.attachments] == [(1, "image", "i.png", 3), (1, "audio", "a.wav", 25), (1, "document", "d.pdf", 3072), (1, "image", None, 1), (2, "image", "o.png", 1)]
    for a in one.attachments:
        mark = f"<|{a.kind}|>"
        assert one.formatted[a.start : a.start + len(mark)] == mark
    assert one.expanded_tokens == 3 + 25 + 3072 + 1 + 1 and one.n_turns == 3
    assert [one.formatted[s.start : s.end] for s in one.loss_spans] == ["ok<|image|>"]
    assert found[2].formatted == "<|role|>user<|text|><|end|>" and found[2].attachments == []
    assert chat.format_chats(spark.createDataFrame([], PARTS)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], TURNS).withColumn("parts", chat.text_parts(F.col("text")))
    plan = chat.digest(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan
