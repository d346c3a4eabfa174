"""Texts that nest deep or hold long numbers have an answer like others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import derive

DEEP = [c * 100_000 for c in ("[", '{"a":')] + ["[" * 100_000 + "]" * 100_000, '{"a":' * 50_000 + "1" + "}" * 50_000, "so: " + '{"a":' * 100_000]


@pytest.mark.parametrize("deep", DEEP, ids=range(len(DEEP)))
def test_deep_json_is_none(deep):
    assert text.first_object(deep) is None


def test_columns_of_deep_json(spark):
    rows = [(i, x) for i, x in enumerate([*DEEP, None, '{"b":1,"a":[2.0]}', "```json\n{\"a\": 1}\n```", 'well {"a": 1} then ' + "[" * 1000])]
    df = spark.createDataFrame(rows, "i int, t string").select("i", text.loose_json("t").alias("loose"), text.canonical_json("t").alias("form"))
    found = {r.i: (r.loose, r.form) for r in df.collect()}
    assert all(found[i] == (None, None) for i in range(6))
    assert found[6] == ('{"b":1,"a":[2.0]}', '{"a":[2],"b":1}') and found[7] == ('{"a": 1}', None) and found[8] == ('{"a": 1}', None)


def test_numbers_of_any_length_go_by_value(spark):
    names = ["a5", "a12345678901234567890", "a007", "a" + "9" * 40, "a1" + "0" * 40, "a10b2", "a10b11", "b1", "a", "", "a0", "a00", "12", "x1y2z3"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(derive.natural(F.col("n")), "n").collect()]
    numbers = [n for n in got if n[:1] == "a" and n[1:].isdigit()]
    assert numbers == sorted(numbers, key=lambda n: (int(n[1:]), n)) and got.index("a10b2") < got.index("a10b11")
    assert df.limit(0).select(derive.natural(F.col("n"))).count() == 0


def test_names_and_checks(spark):
    r = spark.createDataFrame([("a/b c.d", 'say "é"\n', "Try it? Answer: 4", "no mark")], "id string, s string, check string, plain string").select(
        text.stem(F.lit(7), F.col("id")).alias("stem"), text.safe_name(F.lit("a/b:c é.mp4")).alias("name"), text.js_string(F.col("s")).alias("js"), text.js_string(F.lit(None).cast("string")).alias("none"),
        text.learning_check_parts(F.col("check"), "Answer:").alias("parts"), text.learning_check_parts(F.col("plain"), "Answer:").alias("bare"), text.clamp(F.lit(7), 0, 5).alias("clamped"),
    ).first()
    assert r.stem == "007-a-b-c-d" and r.name == "a-b-c é.mp4" and r.js == '"say \\"é\\"\\n"' and r.none == "null"
    assert tuple(r.parts) == ("Try it?", "4") and tuple(r.bare) == ("no mark", "") and r.clamped == 5
