"""Compiled bundles stand before the validator; faults stop a bundle and no other."""

from __future__ import annotations

import copy
import hashlib
import json

from pyspark.sql import functions as F

from tallyspark.functions.text import one_form
from tallyspark.operators import gold, validate
from tallyspark.plans.bundles import asset, span
from tallyspark.plans.gold import drafts
from tallyspark.sources.schemas import BUNDLE

SHA = "d" * 64
DECISION = "bundle_id string, ordinal int, delta_id string, transition_id string, semantic_label string, normalized_speech string, teaching_action string, registration double, segments array<int>, frame struct<frame_id:string,timestamp:double,asset_uri:string,sha256:string>"


def two_steps() -> dict:
    """A second change after the first, on the same surface."""
    b = drafts()
    b["objects"].append(b["objects"][0] | {"object_id": "arrow", "first_visible": 52, "last_visible": 60, "evidence_refs": ["e5"]})
    b["states"].append(b["states"][1] | {"state_id": "s3", "stable_during": span(52, 60), "object_ids": ["box", "arrow"], "representative_asset": asset("s/3.png"), "evidence_refs": ["e5"]})
    b["objects"][0]["last_visible"] = 60
    b["frames"].append(b["frames"][1] | {"frame_id": "f3", "timestamp": 55})
    b["evidence"] += [b["evidence"][1] | {"evidence_id": "e5", "target_id": "f3", "time": span(54, 56)}, b["evidence"][2] | {"evidence_id": "e6", "target_id": "d2", "time": span(50, 52)}]
    b["deltas"].append(copy.deepcopy(b["deltas"][0]) | {"delta_id": "d2", "time": span(50, 52), "before_state_id": "s2", "after_state_id": "s3", "affected_object_ids": ["arrow"], "evidence_refs": ["e2", "e5"]})
    b["transitions"].append(copy.deepcopy(b["transitions"][0]) | {"transition_id": "t2", "time": span(50, 52), "delta_ids": ["d2"], "evidence_refs": ["e6"]})
    b["transitions"][1]["board_action"]["evidence_refs"] = ["e6"]
    b["transitions"][1]["executable_board_moves"][0]["source_delta_ids"] = ["d2"]
    return b


def run(spark, bundles: list[dict], decisions: list[tuple]):
    rows = spark.createDataFrame([(json.dumps(b),) for b in bundles], "body string").select(F.from_json("body", BUNDLE).alias("b")).select("b.*")
    ids = [b["bundle_id"] for b in bundles]
    ledgers = spark.createDataFrame([(i, f"gold-{i}", "2024-06-01T00:00:00.000Z", 1.0) for i in ids], "bundle_id string, adjudication_id string, created_at string, offset double")
    segments = spark.createDataFrame([(i, k, 20.0 + 10 * k, 25.0 + 10 * k, f"part {k}") for i in ids for k in range(4)], "bundle_id string, index int, start double, end double, text string")
    return gold.compile_gold(rows, ledgers, spark.createDataFrame(decisions, DECISION), segments)


def decided(bundle: str, n: int, **more) -> tuple:
    row = {"bundle_id": bundle, "ordinal": n, "delta_id": f"d{n}", "transition_id": f"t{n}", "semantic_label": f"label {n}", "normalized_speech": "said", "teaching_action": "names it", "registration": 0.9, "segments": [0] if n == 1 else [3], "frame": None} | more
    return tuple(row.values())


def test_compiled_bundles_are_valid(spark):
    whole = two_steps() | {"bundle_id": "two"}
    frame = {"frame_id": "u1", "timestamp": 31.5, "asset_uri": "u/1.jpeg", "sha256": SHA}
    made, faults = run(spark, [whole, drafts() | {"bundle_id": "none"}], [decided("two", 2), decided("two", 1, frame=frame)])
    made = made.persist()
    assert faults.count() == 0
    issues = validate.bundle_issues(made.drop("source_bundle_id")).collect()
    assert issues == []
    rows = {r.source_bundle_id: r for r in made.collect()}
    two = rows["two"]
    assert [s.speech_id for s in two.speech] == ["GOLD-SPEECH-01", "GOLD-SPEECH-02"] and [f.frame_id for f in two.frames] == ["f1", "u1", "f2", "f3"]
    assert (two.transitions[0].time.start, two.transitions[0].time.end) == (20, 30) and (two.transitions[1].time.start, two.transitions[1].time.end) == (50, 56)
    assert two.transitions[1].evidence_refs == ["e6", "GOLD-EV-SPEECH-02"] and [d.semantic_label for d in two.deltas] == ["label 1", "label 2"]
    assert {x.status for x in [*two.states, *two.deltas, *two.transitions, *two.surfaces]} == {"accepted"}
    assert {x.status for x in [*rows["none"].states, *rows["none"].deltas, *rows["none"].transitions]} == {"needs_review"} and not rows["none"].speech
    assert two.frames[1].source_asset.asset_uri == f"assets/{SHA}.jpg" and two.states[0].representative_asset.asset_uri.endswith(".png") and two.source.video.asset_uri == "source/video.mp4"


def without_nulls(x):
    if isinstance(x, dict):
        return {k: without_nulls(v) for k, v in x.items() if v is not None}
    return [without_nulls(v) for v in x] if isinstance(x, list) else x


def test_payload_hash_is_that_of_everything_else(spark):
    made, _ = run(spark, [drafts()], [decided("b", 1)])
    r = made.first().asDict(recursive=True)
    body = without_nulls({k: v for k, v in r.items() if k not in ("source_bundle_id", "payload_sha256")})
    assert r["payload_sha256"] == hashlib.sha256(one_form(body).encode()).hexdigest()


def test_faults_stop_their_bundle_alone(spark):
    frame = {"frame_id": "u1", "timestamp": 25.0, "asset_uri": "u/1.png", "sha256": SHA}
    lost = two_steps() | {"bundle_id": "lost"}
    lost["deltas"][0]["before_state_id"] = "s9"
    kinds = {
        "delta": (decided("delta", 1, delta_id="d7"), {"reference.delta"}),
        "transition": (decided("transition", 1, transition_id="t7"), {"reference.transition"}),
        "other": (decided("other", 1, transition_id="t2"), {"transition.delta"}),
        "range": (decided("range", 1, registration=1.5), {"registration.range"}),
        "unset": (decided("unset", 1, registration=None), {"registration.range"}),
        "empty": (decided("empty", 1, segments=[]), {"segment.empty"}),
        "segment": (decided("segment", 1, segments=[0, 9]), {"segment.missing"}),
        "lost": (decided("lost", 1), {"delta.chain"}),
        "nan": (decided("nan", 1, frame=frame | {"timestamp": float("nan")}), {"frame.time"}),
        "taken": (decided("taken", 1, frame=frame | {"frame_id": "f2"}), {"frame.duplicate"}),
        "far": (decided("far", 1, frame=frame | {"timestamp": 50.0}), {"frame.window"}),
        "static": (decided("static", 1, frame=frame | {"sha256": "c" * 64}), {"frame.static"}),
        "fine": (decided("fine", 1, frame=frame), set()),
    }
    bundles = [lost if n == "lost" else two_steps() | {"bundle_id": n} for n in kinds] + [two_steps() | {"bundle_id": "again"}]
    again = [decided("again", 1, frame=frame), decided("again", 2, frame=frame)]
    made, faults = run(spark, bundles, [d for d, _ in kinds.values()] + again)
    found: dict[str, set[str]] = {}
    for r in faults.collect():
        found.setdefault(r.bundle_id, set()).add(r.code)
    assert found == {n: codes for n, (_, codes) in kinds.items() if codes} | {"again": {"frame.duplicate", "frame.reused", "frame.window"}}
    assert [r.source_bundle_id for r in made.collect()] == ["fine"]


def test_no_bundles_and_no_decisions(spark):
    made, faults = run(spark, [drafts()], [])
    assert made.count() == 1 and faults.count() == 0
    assert gold.compile_gold(spark.createDataFrame([], BUNDLE), *[x.limit(0) for x in (spark.createDataFrame([("b", "g", "t", 0.0)], "bundle_id string, adjudication_id string, created_at string, offset double"), spark.createDataFrame([decided("b", 1)], DECISION), spark.createDataFrame([("b", 0, 0.0, 1.0, "t")], "bundle_id string, index int, start double, end double, text string"))])[0].count() == 0


def test_documents_are_parsed_once_and_joined_by_merges(spark, monkeypatch):
    plans = []
    write = gold.materialise

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(gold, "materialise", seen)
    from tallyspark.plans import gold as plan

    plan.gold_faults(spark, "/root/testdata/sf0.001").count()
    assert [name for name, p in plans if "from_json" in p] == ["bundles"]
    assert not any("BroadcastExchange" in p for _, p in plans)
