"""A valid evidence bundle and ways to break it."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from tallyspark.plans.bundles import BOX, SQUARE, asset, claim, span, unknown, valid


def put(*path_and_value) -> Callable[[dict], None]:
    *path, key, value = path_and_value

    def change(bundle: dict) -> None:
        at = bundle
        for step in path:
            at = at[step]
        at[key] = value

    return change


def erase(bundle: dict, **more) -> None:
    """The other way round: the box stands in the first state and is wiped out."""
    bundle["objects"][0] |= {"first_visible": 0, "last_visible": 25, "evidence_refs": ["e1"]}
    bundle["states"][0]["object_ids"], bundle["states"][1]["object_ids"] = ["box"], []
    bundle["frames"].append(bundle["frames"][1] | {"frame_id": "f3", "timestamp": 55})
    bundle["deltas"][0] |= {"operation": "erase", "erase_evidence": {"visibility_restored": True, "absent_from_after_state": True, "confirmed_until": 54.0, "supporting_frame_ids": ["f3"]} | more}


D, T = ("deltas", 0), ("transitions", 0)
#: name -> (change, code that it must give, or None where the bundle stays valid)
CASES: dict[str, tuple[Callable[[dict], None], str | None]] = {
    "valid": (lambda b: None, None),
    "erase": (erase, None),
    "frame twice": (lambda b: b["frames"].append(dict(b["frames"][1])), "frame.duplicate"),
    "id of two kinds": (put("speech", 0, "speech_id", "f1"), "bundle.id_collision"),
    "no frame": (put("frames", []), "bundle.frame_empty"),
    "time order": (put(*D, "time", span(20, 31)), "delta.temporal_order"),
    "outside transition": (put(*D, "time", span(19, 30)), "transition.delta_time"),
    "short state": (put("config", "minimum_stable_seconds", 16), "state.minimum_stable"),
    "evidence missing": (put(*D, "evidence_refs", ["nowhere"]), "evidence_ref.missing"),
    "evidence kind": (put("states", 0, "evidence_refs", ["e4"]), "evidence_ref.kind"),
    "evidence twice": (put(*D, "evidence_refs", ["e1", "e1"]), "evidence_ref.duplicate"),
    "evidence source": (put("evidence", 0, "source_video_id", "other"), "evidence_ref.source"),
    "added before": (put("states", 0, "object_ids", ["box"]), "add.before_object"),
    "not added": (put("states", 1, "object_ids", []), "add.after_object"),
    "state object time": (put("objects", 0, "first_visible", 35), "state.object_time"),
    "state object": (put("states", 1, "object_ids", ["box", "ghost"]), "state.object_ref"),
    "move accepted": (put(*D, "operation", "move"), "move.unverifiable"),
    "move kept": (put(*D, "operation", "move"), "move.object_persistence"),
    "unknown accepted": (put(*D, "operation", "unknown"), "delta.accepted_operation"),
    "modify bare": (put(*D, "operation", "modify"), "modify.relation_missing"),
    "connect bare": (put(*D, "operation", "connect"), "connect.relation_missing"),
    "connect loose": (put(*D, "operation", "connect"), "connect.state_change"),
    "relation": (put(*D, "relation", {"source_object_ids": ["box"], "target_object_ids": ["box"], "relation_type": "r"}), "delta.unexpected_relation"),
    "erase bare": (put(*D, "operation", "erase"), "erase.evidence_missing"),
    "erase hidden": (lambda b: erase(b, visibility_restored=False), "erase.visibility"),
    "erase early": (lambda b: erase(b, confirmed_until=45.0), "erase.persistence"),
    "erase horizon": (lambda b: erase(b, confirmed_until=58.0), "erase.support_horizon"),
    "erase frame": (lambda b: erase(b, supporting_frame_ids=["f1", "f3"]), "erase.frame_time"),
    "confidence": (put(*D, "confidence", "visibility", None), "delta.accepted_confidence"),
    "probability": (put("frames", 0, "visible_fraction", 1.5), "probability.value"),
    "state status": (put("states", 1, "status", "rejected"), "delta.accepted_state_status"),
    "surface status": (put("surfaces", 0, "status", "candidate"), "state.accepted_surface_status"),
    "surface ref": (put("frames", 0, "surface_id", "floor"), "frame.surface_ref"),
    "frame order": (put("frames", 0, "timestamp", 45), "frame.order"),
    "speech order": (lambda b: b["speech"].append(b["speech"][0] | {"speech_id": "w2", "time": span(1, 2)}), "speech.order"),
    "speech level": (put("evidence", 3, "evidence_level", "observable"), "evidence.speech_level"),
    "evidence target": (put("evidence", 0, "target_id", "f9"), "evidence.target_ref"),
    "evidence time": (put("evidence", 0, "time", span(12, 13)), "evidence.time_mismatch"),
    "learner": (put("learner_observations", [{"observation_id": "l1", "source_video_id": "lesson", "time": span(1, 2), "value": "nods", "evidence_refs": ["e1"]}]), "bundle.fabricated_learner"),
    "claim bare": (put(*T, "board_action", claim("draws", "board", "observable")), "claim.observable_support"),
    "claim unheard": (put(*T, "teaching_action", claim("says", "teacher", "teacher_stated", "e3")), "claim.teacher_stated_support"),
    "claim subject": (put(*T, "board_action", claim("draws", "teacher", "observable", "e3")), "claim.subject_slot"),
    "claim unknown": (put(*T, "trigger", unknown() | {"value": "x"}), "claim.unknown_value"),
    "role": (put(*T, "pedagogical_role", claim("dance", "teacher", "inferred", "e4")), "transition.pedagogical_role"),
    "learner claim": (put(*T, "learning_check", claim("nods", "learner_observed", "inferred", "e4")), "transition.fabricated_learner_claim"),
    "move step": (put(*T, "executable_board_moves", 0, "step", 0), "transition.move_step"),
    "move delta": (put(*T, "executable_board_moves", 0, "source_delta_ids", ["d9"]), "transition.move_delta_ref"),
    "no speech": (put(*T, "speech_ids", []), "transition.accepted_speech"),
    "delta asset": (put("evidence", 2, "asset", asset("d/other.png")), "transition.accepted_delta_asset"),
    "delta evidence": (put(*T, "evidence_refs", ["e4"]), "transition.accepted_delta_evidence"),
    "climbing path": (put(*D, "delta_mask", asset("a/%2e%2e/b.png")), "asset.value"),
    "flat polygon": (put("surfaces", 0, "polygon", SQUARE[:3]), "polygon.value"),
    "region": (put(*D, "region", BOX | {"width": 0.95}), "region.value"),
}


def documents() -> list[tuple[str, str]]:
    """(name, bundle as JSON) of every case, the name as its id."""
    out = []
    for name, (change, _) in CASES.items():
        bundle = copy.deepcopy(valid())
        change(bundle)
        out.append((name, json.dumps(bundle | {"bundle_id": name})))
    return out
