"""Small documents with the cases that every operator must bear: nulls, empty and long texts, ties, copies, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ("key", "h", "node", "root", "size", "block", "kept", "spans", "length", "piece", "group", "words", "keys")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary):03d}x" for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    """One word of ``every`` replaced."""
    words = text.split()
    return " ".join(f"new{seed}n{i}" if i % every == every - 1 else w for i, w in enumerate(words))


def rows() -> list[tuple]:
    base = prose(1, 300)
    texts: list[tuple] = [
        (0, None, None, None),
        (1, "", "aa", "s1"),
        (2, " \n\t ", "aa", "s1"),
        (3, "one", "bb", "s2"),
        (4, "Ünïcödé \U0001f600 wörds — ok", "bb", "s2"),
        (5, base, "aa", "s1"),
        (6, base, "aa", "s1"),
        (7, edited(base, 100, 7), "aa", "s3"),
        (8, edited(base, 4, 8), "aa", "s3"),
        (9, prose(2, 20_000), "bb", None),
        (10, "same line here\n" * 40, "bb", "s1"),
        (11, "x" * 30_000, "aa", "s2"),
        (12, "\n".join(prose(3 + i, 12) for i in range(12)), "aa", "s1"),
        (12, "\n".join(prose(3 + i, 12) for i in range(12)), "aa", "s1"),
        (13, base.upper(), "aa", "s1"),
    ]
    texts += [(100 + i, prose(50 + i, 60 + 7 * i), ("aa", "bb")[i % 2], f"s{i % 3}") for i in range(20)]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def documents(spark: SparkSession, clash: bool = False) -> DataFrame:
    docs = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        for name in CLASH:
            docs = docs.selectExpr("*", f"'other' AS `{name}`")
    return docs


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def told(df: DataFrame) -> list[tuple]:
    """Rows in an order of their own, columns by name."""
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
