"""Answers against the schema, shape by shape."""

from __future__ import annotations

import json

from tallyspark.operators import response

GOOD = {
    "schema_version": "teacher-evidence-response-v1",
    "observed_board_actions": [{"sequence_index": 1, "operation": "add", "content": None, "region": "left"}, {"sequence_index": 4, "operation": "unknown", "content": "box", "region": None}],
    "generalized_teaching_capability": {"name": "n", "mechanism": "m", "action_program": ["ask the students to compare"]},
    "evidence_claims": [{"claim": "c", "evidence_slot": "visual-1"}],
    "uncertainties": [],
}


def changed(**more) -> str:
    return json.dumps(GOOD | more)


def action(**more) -> str:
    return changed(observed_board_actions=[GOOD["observed_board_actions"][0] | more])


CASES = {
    "good": (json.dumps(GOOD, indent=1), set()),
    "null": (None, {("", "json.invalid")}),
    "empty": ("", {("", "json.invalid")}),
    "text": ("so it goes", {("", "json.invalid")}),
    "trailing": (json.dumps(GOOD) + "{}", {("", "json.invalid")}),
    "two": ("1,2", {("", "json.invalid")}),
    "mark": ("﻿" + json.dumps(GOOD), {("", "json.invalid")}),
    "deep": ("[" * 100_000, {("", "json.invalid")}),
    "deep objects": ('{"a":' * 5000 + "1" + "}" * 5000, {("", "json.invalid")}),
    "key twice": (json.dumps(GOOD)[:-1] + ',"uncertainties":[]}', {("", "json.invalid")}),
    "list": ("[]", {("", "type")}),
    "null value": ("null", {("", "type")}),
    "bare": ("{}", {("", f"key.missing:{k}") for k in GOOD}),
    "version": (changed(schema_version="v2"), {("/schema_version", "value")}),
    "version kind": (changed(schema_version=1), {("/schema_version", "type")}),
    "more": (changed(**{"a/b~c": 1}), {("/a~1b~0c", "key.unknown")}),
    "actions": (changed(observed_board_actions={}), {("/observed_board_actions", "type")}),
    "action": (changed(observed_board_actions=["x"]), {("/observed_board_actions/0", "type")}),
    "fraction": (action(sequence_index=1.0), {("/observed_board_actions/0/sequence_index", "type")}),
    "large": (action(sequence_index=2**60), {("/observed_board_actions/0/sequence_index", "number.unsafe")}),
    "zero": (action(sequence_index=0), {("/observed_board_actions/0/sequence_index", "order")}),
    "still": (changed(observed_board_actions=[GOOD["observed_board_actions"][1]] * 2), {("/observed_board_actions/1/sequence_index", "order")}),
    "many": (changed(observed_board_actions=[{"sequence_index": i + 1, "operation": "add", "content": None, "region": None} for i in range(12)]), set()),
    "operation": (action(operation="move"), {("/observed_board_actions/0/operation", "value")}),
    "region": (action(region=[]), {("/observed_board_actions/0/region", "type")}),
    "capability": (changed(generalized_teaching_capability={"name": " ", "mechanism": "", "action_program": [], "x": {"y": 1}}), {("/generalized_teaching_capability/name", "blank"), ("/generalized_teaching_capability/mechanism", "blank"), ("/generalized_teaching_capability/action_program", "empty"), ("/generalized_teaching_capability/x", "key.unknown")}),
    "claim": (changed(evidence_claims=[{"claim": "c", "evidence_slot": "visual-2"}, {"claim": None}]), {("/evidence_claims/0/evidence_slot", "value"), ("/evidence_claims/1/claim", "type"), ("/evidence_claims/1", "key.missing:evidence_slot")}),
    "unsure": (changed(uncertainties=["", 3]), {("/uncertainties/0", "blank"), ("/uncertainties/1", "type")}),
}


def test_every_shape(spark):
    df = spark.createDataFrame([(n, "oracle_delta", t) for n, (t, _) in CASES.items()], "id string, arm string, text string")
    found: dict[str, set] = {}
    for r in response.schema_issues(df).collect():
        found.setdefault(r.id, set()).add((r.pointer, r.code))
    assert {n: found.get(n, set()) for n in CASES} == {n: want for n, (_, want) in CASES.items()}


def test_slots_by_arm(spark):
    df = spark.createDataFrame([(arm or "none", arm, json.dumps(GOOD)) for arm in ("transcript_only", "uniform_frame", None)], "id string, arm string, text string")
    assert [tuple(r) for r in response.schema_issues(df).collect()] == [("transcript_only", "/evidence_claims/0/evidence_slot", "value")]


def test_advice_filters_nothing(spark):
    texts = {
        "plain": changed(),
        "shown": action(content="the students write"),
        "achieved": changed(evidence_claims=[{"claim": "学生已经掌握了方法", "evidence_slot": "transcript"}]),
        "taught": changed(generalized_teaching_capability={"name": "Students solved the problem.", "mechanism": "m", "action_program": ["ask the students to compare"]}),
        "sure": changed(uncertainties=["students followed, outcome unknown"]),
        "unsure": changed(uncertainties=["whether students followed is unknown", "the date"]),
        "broken": "{",
    }
    df = spark.createDataFrame([(n, "oracle_delta", t) for n, t in texts.items()], "id string, arm string, text string")
    found = sorted(tuple(r) for r in response.lint(df).collect())
    assert found == [
        ("achieved", "/evidence_claims/0/claim", "lint.learner"), ("achieved", "/evidence_claims/0/claim", "lint.outcome"), ("shown", "/observed_board_actions/0/content", "lint.learner"),
        ("sure", "/uncertainties/0", "lint.uncertainty"), ("taught", "/generalized_teaching_capability/name", "lint.outcome"),
    ]
    assert response.schema_issues(df.where("id <> 'broken'")).count() == 0


def test_lint_parses_answers_that_may_warn_only_and_misses_none(spark, monkeypatch):
    quiet, said = [action(content="a box"), action(content="X").replace('"X"', '"图像"')], ["Students solved it", "PUPILS did", "the claſs solved it", "THE PUPİLS did", "pupıls did", "They know", "同学们做对", "其", "小明作答", "stud\\u0065nts did"]
    texts = [*quiet, None, "", *(action(content="X").replace('"X"', f'"{t}"') for t in said), *(changed(uncertainties=[t]) for t in said)]
    df = spark.createDataFrame([(str(i), "oracle_delta", t) for i, t in enumerate(texts)], "id string, arm string, text string")
    taught = GOOD["generalized_teaching_capability"] | {"action_program": ["compare"]}
    plain = df.withColumn("text", response.F.replace("text", response.F.lit("ask the students to compare"), response.F.lit(taught["action_program"][0])))
    kept = {r.id for r in plain.where(response.hinted(response.F.col("text"))).collect()}
    assert kept == {str(i) for i in range(4, len(texts))}
    found = sorted(map(tuple, response.lint(df).collect()))
    monkeypatch.setattr(response, "hinted", lambda text: response.F.lit(True))
    assert found and found == sorted(map(tuple, response.lint(df).collect()))
