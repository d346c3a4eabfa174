"""Evidence bundles made of customers, some of them broken by rule, and what a validator must say of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import validate
from tallyspark.sources.schemas import BUNDLE
from tallyspark.sources.tables import load, materialise

SHA = "c" * 64
BOX = {"x": 0.1, "y": 0.1, "width": 0.3, "height": 0.2}
SQUARE = [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}, {"x": 0, "y": 1}]


def asset(name: str) -> dict:
    return {"asset_uri": name, "sha256": SHA}


def unknown() -> dict:
    return {"value": None, "subject": "unknown", "level": "unknown", "confidence": None, "evidence_refs": []}


def claim(value: str, subject: str, level: str, *refs: str) -> dict:
    return {"value": value, "subject": subject, "level": level, "confidence": 0.7, "evidence_refs": list(refs)}


def span(a: float, b: float) -> dict:
    return {"start": a, "end": b}


def valid() -> dict:
    """One surface; an empty state, then one with a box that is drawn in between and spoken about."""
    on = {"source_video_id": "lesson", "surface_id": "wall"}
    vid = {"source_video_id": "lesson"}
    frame = lambda i, t: {"frame_id": i, **on, "timestamp": t, "source_asset": asset(f"f/{i}.jpg"), "registration_score": 0.9, "visible_fraction": 0.8}
    seen = lambda i, kind, target, a, b, level="observable", **more: {"evidence_id": i, "kind": kind, "target_id": target, **vid, "time": span(a, b), "evidence_level": level, **more}
    return {
        "bundle_id": "b", "schema_version": "temporal-board-v2", "created_at": "2024-05-01T00:00:00.000Z", "teacher_only_recording": True, "immutable": True, "payload_sha256": SHA,
        "source": {"source_video_id": "lesson", "video": asset("v/lesson.mp4"), "duration_seconds": 60},
        "config": {"mode": "pilot", "minimum_stable_seconds": 3, "speech_window_seconds": 4, "board_roi": SQUARE, "ignore_regions": []},
        "surfaces": [{"surface_id": "wall", **vid, "kind": "whiteboard", "calibration": "manual", "polygon": SQUARE, "ignore_regions": [], "valid_during": span(0, 60), "status": "accepted", "diagnostics": []}],
        "frames": [frame("f1", 10), frame("f2", 40)],
        "objects": [{"object_id": "box", **on, "kind": "diagram", "region": BOX, "semantic_text": "box", "semantic_source": "human", "first_visible": 30, "last_visible": 50, "evidence_refs": ["e2"]}],
        "states": [
            {"state_id": "s1", **on, "stable_during": span(5, 20), "representative_asset": asset("s/1.png"), "object_ids": [], "observed_support": 0.9, "evidence_refs": ["e1"], "status": "accepted"},
            {"state_id": "s2", **on, "stable_during": span(30, 50), "representative_asset": asset("s/2.png"), "object_ids": ["box"], "observed_support": 0.9, "evidence_refs": ["e2"], "status": "accepted"},
        ],
        "deltas": [{
            "delta_id": "d1", **on, "time": span(20, 30), "before_state_id": "s1", "after_state_id": "s2", "operation": "add", "region": BOX, "affected_object_ids": ["box"], "delta_mask": asset("d/m.png"), "comparison_asset": asset("d/c.png"),
            "semantic_label": "a box", "confidence": {"visibility": 1, "registration": 1, "persistence": 1, "operation": 1, "ocr": None, "speech_alignment": 1, "pedagogical_inference": 0.5}, "evidence_refs": ["e1", "e2"],
            "erase_evidence": None, "relation": None, "modification": None, "status": "accepted", "uncertainty_codes": [],
        }],
        "speech": [{"speech_id": "w1", **vid, "time": span(21, 29), "raw_text": "now a box", "normalized_text": None, "normalization": "none", "source_segment_indexes": [3]}],
        "evidence": [seen("e1", "frame", "f1", 9, 11), seen("e2", "frame", "f2", 39, 41), seen("e3", "board_delta", "d1", 20, 30, asset=asset("d/c.png")), seen("e4", "speech", "w1", 21, 29, "teacher_stated")],
        "transitions": [{
            "transition_id": "t1", **vid, "time": span(20, 30), "delta_ids": ["d1"], "speech_ids": ["w1"], "evidence_refs": ["e3", "e4"],
            "trigger": unknown(), "teaching_action": claim("names it", "teacher", "teacher_stated", "e4"), "board_action": claim("draws it", "board", "observable", "e3"), "pedagogical_role": claim("definition", "teacher", "inferred", "e4"),
            "expected_learner_change": unknown(), "learning_check": unknown(), "remediation": unknown(), "observed_learner_response": None,
            "executable_board_moves": [{"step": 1, "operation": "introduce", "pedagogical_target": "box", "render_instruction": "draw", "success_signal": None, "source_delta_ids": ["d1"]}], "status": "accepted", "uncertainty_codes": [],
        }],
        "learner_observations": [], "warnings": [],
    }


#: place in the bundle, value where a customer's key is a multiple of the number, and the issues (entity, id, code) that this makes.
BREAKS = {
    3: (("transitions", 0, "speech_ids"), [], [("transition", "t1", "transition.accepted_speech")]),
    5: (("frames", 0, "visible_fraction"), 1.5, [("frame", "f1", "probability.value")]),
    7: (("deltas", 0, "time"), span(20, 31), [("delta", "d1", "delta.temporal_order"), ("transition", "t1", "transition.delta_time")]),
    11: (("config", "minimum_stable_seconds"), 16, [("state", "s1", "state.minimum_stable")]),
    13: (("states", 1, "status"), "rejected", [("delta", "d1", "delta.accepted_state_status")]),
    17: (("evidence", 2, "asset"), asset("d/other.png"), [("transition", "t1", "transition.accepted_delta_asset")]),
    19: (("speech", 0, "raw_text"), " ", [("speech", "w1", "speech.raw_text")]),
}


def bundles(spark: SparkSession, d: str) -> DataFrame:
    whole = valid()
    swaps = []
    for n, (path, value, _) in BREAKS.items():
        at = whole
        for step in path[:-1]:
            at = at[step]
        swaps.append((n, json.dumps(at[path[-1]]), json.dumps(value)))
        at[path[-1]] = f"@{n}@"
    body = F.replace(F.lit(json.dumps(whole)), F.lit('"bundle_id": "b"'), F.concat(F.lit('"bundle_id": "'), F.col("c_custkey").cast("string"), F.lit('"')))
    for n, own, other in swaps:
        body = F.replace(body, F.lit(f'"@{n}@"'), F.when(F.col("c_custkey") % n == 0, other).otherwise(own))
    return load(spark, d, "customer").select(F.from_json(body, BUNDLE).alias("b")).select("b.*")


def bundle_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.bundle_issues(materialise(bundles(spark, d), "bundles"))


QUERIES = {"bundle_issues": bundle_issues}
SQL = {"bundle_issues": "\nUNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS bundle_id, '{entity}' AS entity, '{i}' AS entity_id, '{code}' AS code FROM customer WHERE c_custkey % {n} = 0" for n, (_, _, issues) in BREAKS.items() for entity, i, code in issues)}
