"""Promotion rules, plans, signoffs and transcripts on rows that break one rule each."""

from __future__ import annotations

from pyspark.sql import functions as F
from tallyspark.functions import transcript
from tallyspark.operators import policy

RECORD = "decision string, split string, selection_gain double, worst_group_delta double, unsupported_claim_rate_delta double, answer_leakage_rate_delta double, critical_physics_errors int, critical_diagram_errors int, family_deltas array<struct<family_id:string,episode_success_delta:double>>, gate_results array<struct<gate:string,status:string>>"
GOOD = {
    "decision": "promote", "split": "selection", "selection_gain": 0.05, "worst_group_delta": -0.02, "unsupported_claim_rate_delta": 0.0, "answer_leakage_rate_delta": -0.1, "critical_physics_errors": 0, "critical_diagram_errors": 0,
    "family_deltas": [("f", 0.1), ("g", 0.2), ("h", -0.3)], "gate_results": [(g, "pass") for g in "abcd"],
}
BROKEN = {
    "good": ({}, set()),
    "low gain": ({"selection_gain": 0.04}, {"policy.metric_threshold"}),
    "no gain": ({"selection_gain": None}, {"policy.metric_threshold"}),
    "worst": ({"worst_group_delta": -0.03}, {"policy.metric_threshold"}),
    "rise": ({"answer_leakage_rate_delta": 0.01}, {"policy.metric_threshold"}),
    "split": ({"split": "test"}, {"policy.test_leakage"}),
    "gate": ({"gate_results": [("a", "pass"), ("b", "pass"), ("c", "pass"), ("d", "fail")]}, {"policy.gate_result"}),
    "gate twice": ({"gate_results": [("a", "pass")] * 4}, {"policy.gate_result"}),
    "no gates": ({"gate_results": None}, {"policy.gate_result"}),
    "families": ({"family_deltas": [("f", 0.1), ("f", 0.2)]}, {"policy.family_gain"}),
    "errors": ({"critical_diagram_errors": 1}, {"policy.critical_error"}),
    "held back": ({"decision": "hold", "selection_gain": None}, set()),
}


def test_promotion(spark):
    names = [c.split()[0] for c in RECORD.split(", ")]
    rows = [(name, tuple((GOOD | change)[c] for c in names)) for name, (change, _) in BROKEN.items()]
    df = spark.createDataFrame(rows, f"id string, p struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>")
    found: dict = {}
    for r in policy.promotion_issues(df, "id", "p").collect():
        found.setdefault(r.id, set()).add(r.code)
    assert {n: found.get(n, set()) for n in BROKEN} == {n: want for n, (_, want) in BROKEN.items()}


def test_references_plans_and_steps(spark):
    experiences = spark.createDataFrame([("e1", "WRITE"), ("e2", "NO_WRITE")], "id string, write_mode string")
    uses = spark.createDataFrame([("h1", "e1"), ("h2", "e2"), ("h3", "e9")], "user string, id string")
    assert sorted(map(tuple, policy.unwritable_references(experiences, uses, "id").select("user", "code").collect())) == [("h2", "policy.no_write_ref"), ("h3", "policy.experience_ref")]
    actions = spark.createDataFrame([("s", a, i) for i, a in enumerate("abc")], "k string, action_id string, at int")
    plans = spark.createDataFrame([("s", ["a", "b"]), ("s", ["b", "z"])], "k string, action_ids array<string>")
    assert sorted(map(tuple, policy.plan_issues(actions, plans, ["k"]).collect())) == [("s", "b", "render_plan.coverage"), ("s", "c", "render_plan.coverage"), ("s", "z", "render_plan.action_ref")]
    steps = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 2), ("s", 3, None), ("t", 0, 5)], "k string, at int, step int")
    assert sorted(r["at"] for r in policy.step_issues(steps, ["k"], "at", "step").collect()) == [2, 3]


def test_signoffs_and_windows(spark):
    rows = [("p", "visual", "ann", ["x", "y"]), ("p", "physics", "bob", ["y", "x"]), ("q", "visual", "ann", ["x"]), ("q", "physics", "ann", ["z"]), ("r", "visual", "ann", ["x"]), ("s", "other", "cy", ["x"])]
    found = sorted(map(tuple, policy.signoff_issues(spark.createDataFrame(rows, "package string, signoff_role string, adjudicator_id string, decision_signatures array<string>"), "package", ["visual", "physics"]).collect()))
    assert found == [("q", "signoff.commitment"), ("q", "signoff.same_person"), ("r", "signoff.missing"), ("s", "signoff.missing")]
    groups = spark.createDataFrame([("p", 0.0, 5.0), ("p", 1.0, 2.0), ("p", 6.0, 7.0), ("p", 20.0, 21.0), ("q", 0.0, 1.0)], "package string, a double, b double")
    assert sorted(map(tuple, policy.component_windows(groups, "package", "a", "b", 1.0).collect())) == [("p", 0.0, 7.0, 3), ("p", 20.0, 21.0, 1), ("q", 0.0, 1.0, 1)]


def test_transcripts(spark):
    rows = [
        ("own", [(0.0, 1.5, " hi "), (2.0, 3.0, " "), (61.25, 3700.0, "bye")], None, None),
        ("raw", None, [(("00:00:01.500", "00:00:02.000"), None, "one"), (None, (2000, 4000), "two")], None),
        ("none", None, None, 9.0),
    ]
    df = spark.createDataFrame(rows, f"id string, segments {transcript.SEGMENTS}, transcription {transcript.RAW}, duration double")
    parts = df.select("id", "duration", transcript.segments(F.col("segments"), F.col("transcription")).alias("parts"))
    found = {r.id: r for r in parts.select("id", "parts", transcript.duration(F.col("duration"), F.col("parts")).alias("seconds"), transcript.captions(F.col("parts")).alias("srt"), transcript.plain_text(F.col("parts")).alias("txt"), transcript.index_lines(F.col("parts")).alias("lines")).collect()}
    assert found["own"].srt == "1\n00:00:00,000 --> 00:00:01,500\nhi\n\n2\n00:01:01,250 --> 01:01:40,000\nbye\n" and found["own"].seconds == 3700.0
    assert [tuple(p) for p in found["raw"].parts] == [(1.5, 2.0, "one"), (2.0, 4.0, "two")] and found["raw"].txt == "one\ntwo"
    assert found["raw"].lines == "0\t00:00:01.500\t00:00:02.000\tone\n1\t00:00:02.000\t00:00:04.000\ttwo"
    assert found["none"].parts == [] and found["none"].srt == "" and found["none"].seconds == 9.0
    stored = parts.where("id = 'raw'").withColumns({"text": F.lit("one\ntwo"), "srt": F.lit("other")})
    assert [tuple(r) for r in transcript.render_issues(stored, "id", "parts", "text", "srt").collect()] == [("raw", "captions")]
    cites = spark.createDataFrame([("raw", "c", [1, 0, 7], 10.0)], "id string, citation string, at array<int>, shift double")
    assert [tuple(r) for r in transcript.cited_span(cites, parts.withColumnRenamed("parts", "segments"), "id", "at", "shift").collect()] == [("raw", "c", 11.5, 14.0, "two one")]
