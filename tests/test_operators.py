"""Operators whose queries have no SQL: packing, keyed hashes, the bootstrap and rollups."""

from __future__ import annotations

import hashlib
import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.functions import text
from tallyspark.operators import bootstrap, packing, quantiles, retrieval, temporal
from tallyspark.plans import texts


def test_keyed_hashes(spark):
    rows = [("",), ("abc",), ("ünï \U0001f600" * 40,)]
    df = spark.createDataFrame(rows, "m string")
    for key in (b"", b"key", b"k" * 64, b"long" * 40):
        got = {r.m: r.h for r in df.select("m", text.hmac_sha256(key, F.col("m")).alias("h")).collect()}
        assert got == {m: hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for (m,) in rows}


def plain_batches(sizes: list[int], items: int, most: int) -> list[int]:
    out, number, held, total = [], 0, 0, 0
    for size in sizes:
        if held and (held == items or total + size > most):
            number, held, total = number + 1, 0, 0
        out.append(number)
        held, total = held + 1, total + size
    return out


def test_batches(spark):
    r = random.Random(2)
    lists = [[r.randrange(1, 40) for _ in range(r.randrange(0, 30))] for _ in range(40)] + [[61, 1]]
    df = spark.createDataFrame([(i, j, x) for i, sizes in enumerate(lists) for j, x in enumerate(sizes)], "i int, j int, size long").repartition(5)
    got: dict = {}
    for x in sorted(packing.batch_rows(df, "i", ["j"], "size", 4, 60).collect()):
        got.setdefault(x.i, []).append(x.batch)
    assert got == {i: plain_batches(sizes, 4, 60) for i, sizes in enumerate(lists) if sizes and max(sizes) <= 60}


def test_percentiles_are_those_of_all_values(spark):
    r = random.Random(9)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 3000), (None, 50)) for v in [r.choice((0.0, 1.5, r.gauss(0, 1), r.expovariate(1) ** 4)) for _ in range(n)]] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    at = (0.0, 0.025, 0.1, 0.5, 0.9, 0.975, 1.0)
    got = {(x.k, x.p): x.v for x in quantiles.percentiles(df, ["k"], "v", at).collect()}
    values = {k: [v for key, v in rows if key == k and v is not None] for k in ("a", "b", "c", None)}
    assert got == {(k, p): pytest.approx(float(np.quantile(v, p)), abs=1e-12) for k, v in values.items() for p in at}
    whole = [v for _, v in rows if v is not None]
    assert quantiles.percentiles(df, [], "v", (0.3,)).first().v == pytest.approx(float(np.quantile(whole, 0.3)))
    assert quantiles.percentiles(df.where("false"), ["k"], "v", at).count() == 0


def test_nearest_targets_across_stretches(spark):
    r = random.Random(4)
    points = [(i, f"k{r.randrange(3)}", r.randrange(-400, 400)) for i in range(150)]
    targets = [(i, f"k{r.randrange(2)}", r.randrange(-400, 400)) for i in range(40)] + [(99, "k0", None)]
    p, t = spark.createDataFrame(points, "i int, k string, at long"), spark.createDataFrame(targets, "id long, k string, t long")
    for bucket in (1, 30, 10_000):
        for x in temporal.nearest(p, t.where("t is not null"), "k", "at", "t", "id", bucket).collect():
            want = min(((abs(b - x["at"]), b, i) for i, k, b in targets if k == x.k and b is not None), default=None)
            assert (x.gap, x.nearest_id) == ((want[0], want[2]) if want else (None, None))
        spans = p.withColumn("start", F.col("at")).withColumn("end", F.col("at") + 9).drop("at")
        near = {x.i for x in temporal.near_semi_join(spans, t.select("k", F.col("t").alias("at")).where("at is not null"), "k", 5, bucket).collect()}
        assert near == {i for i, k, a in points if any(kk == k and b is not None and a - 5 <= b <= a + 14 for _, kk, b in targets)}


def test_lexical_rank_is_that_of_all_pairs(spark):
    """Common words, questions of common words alone, ties and phrases, against every pair."""
    r = random.Random(6)
    rare = [f"rare{i}x" for i in range(60)]
    records = [(i, ", ".join(r.sample(["common", "often", *rare], 2)), ", ".join(["common", *r.sample(rare, 2)]), [f"phrase{i % 9}"], r.randrange(3)) for i in range(400)]
    questions = [(i, ", ".join(q)) for i, q in enumerate([["common"], ["common", "often"], ["often", rare[3]], [rare[1], rare[2], "common"], ["nothing"], ["phrase3", "common"], [rare[7]], []])]
    df = spark.createDataFrame(records, "record_id long, title string, body string, phrases array<string>, modalities int")
    asked = spark.createDataFrame(questions, "question_id int, question string")
    token = lambda s: {w for w in s.lower().replace(" ", "").split(",") if len(w) > 1}
    for k in (1, 5):
        got: dict = {}
        for x in sorted(retrieval.rank(asked, df, k).collect(), key=lambda x: (x.question_id, x.place)):
            got.setdefault(x.question_id, []).append((x.record_id, x.score))
        for i, q in questions:
            scores = []
            for rid, title, body, phrases, m in records:
                a, b, n = len(token(q) & token(title)), len(token(q) & token(body)), max(1, len(token(q)))
                asked_text = q.replace(" ", "")
                boost = 2.0 if any(p in asked_text or (asked_text and asked_text in p) for p in phrases) else 0.0
                scores.append((-round(3 * a + b + (a + b) / n + boost + 0.08 * m, 9), rid))
            assert got[i] == [(rid, pytest.approx(-s, abs=1e-4)) for s, rid in sorted(scores)[:k]], q


def test_lexical_rank_scores_equal_records_once(spark, monkeypatch):
    """Copies share their score: the table that candidates come from has a row for each distinct content, and the smallest ids are placed."""
    tables = {}
    write = retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name: tables.setdefault(name, write(df, name)))
    contents = [("bolt", "red", ["bolt"], 0), ("bolt", "blue", ["nut"], 0), ("nut", "red", [], 1), ("nut", None, None, 0)]
    records = [(100 * c + i, *contents[i % 4]) for c in range(40) for i in (3, 1, 0, 2)] + [(None, *contents[0]), (7, "bolt", "red", ["bolt"], 2)]
    df = spark.createDataFrame(records, "record_id long, title string, body string, phrases array<string>, modalities int")
    asked = spark.createDataFrame([(0, "bolt, red"), (1, "nut"), (2, "none")], "question_id int, question string")
    got: dict = {}
    for x in sorted(retrieval.rank(asked, df, 3).collect(), key=lambda x: (x.question_id, x.place)):
        got.setdefault(x.question_id, []).append(x.record_id)
    assert got == {0: [7, 0, 100], 1: [2, 102, 202], 2: [7, 2, 102]}
    assert tables["rank-contents"].count() == 5 and max(len(r.ids) for r in tables["rank-contents"].collect()) == 3


def test_leaks_join_without_texts(spark):
    hay = spark.createDataFrame([(1, "xx secret value yy"), (2, "se-cret_VALUE"), (3, "none"), (4, None)], "public_id long, text string")
    needle = spark.createDataFrame([(1, "Secret Value"), (2, "abc"), (3, None), (4, "secret")], "private_id long, value string")
    found = retrieval.leaks(hay, needle, "text", "value")
    assert {tuple(x) for x in found.collect()} == {(1, 1), (2, 1), (1, 4), (2, 4)}


def test_chunks_join_to_the_text_and_keep_the_limit(spark):
    r = random.Random(3)
    texts = ["\n".join("x" * r.randrange(1, 30) for _ in range(r.randrange(1, 20))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", packing.chunk_lines(F.col("t"), 60).alias("c")).collect():
        assert "".join(row.c) == texts[row.i] + "\n"
        assert all(len(c) <= 60 for c in row.c)
        for a, b in zip(row.c, row.c[1:], strict=False):  # the next chunk's first line would not have fitted
            assert len(a) + b.index("\n") + 1 > 60


def test_bootstrap_is_paired_and_repeats(spark):
    r = random.Random(5)
    rows = [(f"t{t}", f"v{t}{v}", "c", s, arm, r.random() + (0.5 if arm == "x" else 0.0)) for t in range(3) for v in range(2) for s in range(3) for arm in ("x", "y")]
    df = spark.createDataFrame(rows, "teacher string, video string, case_id string, seed int, arm string, f1 double")
    levels = ["teacher", "video", "case_id", "seed"]
    one, two = (bootstrap.bootstrap_difference(df, levels, "arm", "x", "y", ["f1"], 11, 60) for _ in range(2))
    values = sorted(x.f1 for x in one.select("f1").collect())
    assert values == sorted(x.f1 for x in two.select("f1").collect()) and len(values) == 60
    assert len({round(v, 12) for v in values}) > 30
    got = bootstrap.intervals(one, ["f1"]).first()
    want = np.percentile(values, [2.5, 10, 90, 97.5])
    assert np.allclose([got.low95, got.low80, got.high80, got.high95], want)
    same = df.withColumn("f1", F.when(F.col("arm") == "x", 1.25).otherwise(1.0))
    assert {round(x.f1, 12) for x in bootstrap.bootstrap_difference(same, levels, "arm", "x", "y", ["f1"], 11, 20).select("f1").collect()} == {0.25}


def in_order(cells: list[tuple], seed: int, replicates: int) -> list[tuple]:
    """The plan from one sequence of numbers, replicate after replicate."""
    numbers, out = bootstrap.draws(seed), []

    def walk(rows: list[tuple], depth: int, slot: tuple, replicate: int) -> None:
        if depth == len(cells[0]):
            out.append((replicate, ".".join(map(str, slot[:-1])), slot[-1], *rows[0]))
            return
        names = sorted({x[depth] for x in rows})
        for i in range(len(names)):
            pick = names[int(next(numbers) * len(names))]
            walk([x for x in rows if x[depth] == pick], depth + 1, (*slot, i), replicate)

    for r in range(replicates):
        walk(cells, 0, (), r)
    return sorted(out)


def test_bootstrap_plan_is_one_sequence_made_by_tasks(spark, monkeypatch):
    even = [(t, v, s) for t in "abc" for v in ("u", "v") for s in range(3)]
    uneven = [x for x in even if x not in {("a", "u", 0), ("b", "v", 1), ("b", "v", 2)}] + [("d", "w", 0)]
    for cells in (even, uneven):
        plan = bootstrap.resample_plan(spark.createDataFrame(cells, "t string, v string, s int"), ["t", "v", "s"], 77, 40)
        assert sorted(tuple(x) for x in plan.collect()) == in_order(cells, 77, 40)
        assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(bootstrap, "MAX_CELLS", 5)
    with pytest.raises(ValueError, match="5 distinct cells"):
        bootstrap.resample_plan(spark.createDataFrame(even, "t string, v string, s int"), ["t", "v", "s"], 77, 40)


def test_registered_bootstrap_has_a_thousand_replicates(spark, monkeypatch):
    asked, whole = [], bootstrap.bootstrap_difference
    monkeypatch.setattr(bootstrap, "bootstrap_difference", lambda *a: asked.append(a[-1]) or whole(*a))
    texts.bootstrap_ci(spark, "/root/testdata/sf0.001")
    assert asked[0] >= 1000


def plain_frames(duration: float, cues: list[float], scenes: list[float], most: int = 20) -> list[tuple]:
    """Cues, then scenes 4 s apart, then even periods; none within 3 s of a chosen one or in the last 0.2 s."""
    wanted = [(0, max(0.0, c + 0.5), "transcript_cue") for c in cues[:8]]
    spaced: list[float] = []
    for s in sorted(max(0.0, s) for s in scenes):
        if len(spaced) < 8 and all(abs(s - x) >= 4 for x in spaced):
            spaced.append(s)
    wanted += [(1, s, "scene_change") for s in spaced]
    if duration > 1:
        n = min(6, max(1, int(duration // 60) + 1))
        wanted += [(2, round(duration / (n + 1) * i, 3), "periodic") for i in range(1, n + 1)]
    chosen: list[tuple] = []
    for _, at, why in sorted(wanted):
        if at < max(duration - 0.2, 0.2) and len(chosen) < most and all(abs(at - x) >= 3 for x, _ in chosen):
            chosen.append((at, why))
    return sorted((round(at, 3), why) for at, why in chosen)


def test_keyframe_plans(spark):
    r = random.Random(8)
    rows = [(i, d, sorted(r.uniform(0, d) for _ in range(r.randrange(12))), [r.uniform(-1, d) for _ in range(r.randrange(14))]) for i, d in enumerate([0.5, 1.0, 5.0, 30.0, 61.0, 200.0, 900.0] * 6)]
    df = spark.createDataFrame(rows, "i int, duration double, cues array<double>, scenes array<double>")
    for x in temporal.frame_plan(df).collect():
        assert [(pytest.approx(p["at"]), p["reason"]) for p in x.plan] == plain_frames(x.duration, x.cues, x.scenes), rows[x.i]


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(text.clamp(F.lit(x), 0.0, 1.0)) for x in (-1.0, 0.4, 7.0)] == [0.0, 0.4, 1.0]
    said = {"```json\n{\"a\": 1}\n```": '{"a": 1}', "so {x} then {\"a\": {\"b\": 2}} }": '{"a": {"b": 2}}', "none": None, "[1]": "[1]", "{\"a\": NaN}": None, "": None}
    df = spark.createDataFrame([(k,) for k in said], "s string")
    assert {x.s: x.j for x in df.select("s", text.loose_json("s").alias("j")).collect()} == said
    forms = {'{"b":1.0,"a":[true,null,"\\u00e9"]}': '{"a":[true,null,"é"],"b":1}', '{"x":1e-7,"y":-0.5,"\\ud83d\\ude00":0}': '{"x":1e-07,"y":-0.5,"😀":0}', "nope": None}
    df = spark.createDataFrame([(k,) for k in forms], "s string")
    assert {x.s: x.j for x in df.select("s", text.canonical_json("s").alias("j")).collect()} == {**forms, '{"x":1e-7,"y":-0.5,"\\ud83d\\ude00":0}': '{"x":1e-7,"y":-0.5,"😀":0}'}


def test_outcomes_of_learners(spark):
    said = {
        "Students solved the problem.": True, "The class understood it at once": True, "Learners can now solve it": True, "Pupils responded correctly": True,
        "Ask the students to solve it.": False, "If students understand, go on": False, "Help learners improve": False, "Students should reach better accuracy": False, "Students should practice; accuracy rises": True,
        "The class may improve later.": False, "Ask the students to try; then they answered correctly": True, "The board is complete": False, "": False,
        "学生已经掌握了方法": True, "大家都听懂了": True, "引导学生理解图像": False, "如果学生理解": False, "学生将理解": False, "老师答对了": False, "小明答对了": True, "𠀀𠀁做对了": True, "板书完成": False,
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "s string")
    got = {x.s: x.flag for x in retrieval.outcome_flags(df, "s", "flag").collect()}
    assert got == {**said, None: None}
    assert got == {x.s: x.flag for x in df.select("s", retrieval.fabricated_outcome("s").alias("flag")).collect()}
