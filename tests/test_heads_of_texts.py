"""Slugs and titles come from the beginning of a text, however long it or its runs of blanks are."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyspark.functions import text

TEXTS = ["", "  ", "--", "a", "A b  c", "word " * 40, "-" * 5000 + "x" * 70 + "!", "!?" * 3000 + "ab " * 3000, "x" * 62 + "  y", "x" * 63 + "-", "x" * 64 + "z", "a-" * 31 + "b-c", " a" * 90, "\n\t" * 4000 + "İK" * 40, "K" * 70, "图像 " * 50, "𠀀 b" * 40, "é " * 30, "q" * 28 + "   ", "q" * 28 + "  r", "  " + "q" * 29]


def slug(t: str) -> str:
    out = re.sub(r"^-|-$", "", re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9-]+", "-", t.lower())))
    return re.sub(r"-$", "", (out or "doc")[:63])


def title(t: str) -> str:
    short = re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")
    return short[:28] + "…" if len(short) > 28 else short


def test_heads_give_what_whole_texts_give(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", text.slug(F.col("t"), "doc").alias("s"), text.auto_title(F.col("t")).alias("n"))
    assert {r.i: (r.s, r.n) for r in df.collect()} == {i: (slug(t), title(t)) for i, t in enumerate(TEXTS)}


def test_patterns_replace_in_heads_only(spark):
    for out in (text.slug(F.col("t"), "doc"), text.auto_title(F.col("t"))):
        plan = spark.createDataFrame([("a",)], "t string").select(out)._jdf.queryExecution().analyzed().toString()
        assert re.search(r"regexp_replace\((lower\()?regexp_extract\(", plan)
