"""Validation of evidence bundles: every rule gives issue rows (bundle_id, entity, entity_id, code).

A bundle is one nested row (``schemas.BUNDLE``). Its child arrays become tables keyed by bundle; references are joins
on (bundle_id, id), membership tests are array functions, and order tests are windows by place. All rules of a table
are evaluated in one pass over it, so a batch of bundles costs a fixed number of joins however many rules there are.
Every join is a merge of two shuffles: all tables grow with the bundles, and shuffled sizes, small when packed, would send
dozens of them through the driver to be broadcast at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import safe_relative_uri

SHA = "^[0-9a-fA-F]{64}$"
STATUSES = ("candidate", "needs_review", "accepted", "rejected")
CHILDREN = {
    "surfaces": ("surface", "surface_id"),
    "frames": ("frame", "frame_id"),
    "objects": ("object", "object_id"),
    "states": ("state", "state_id"),
    "deltas": ("delta", "delta_id"),
    "speech": ("speech", "speech_id"),
    "evidence": ("evidence", "evidence_id"),
    "transitions": ("transition", "transition_id"),
    "learner_observations": ("learner_observation", "observation_id"),
}
# Claims with their subjects, roles and moves.
CLAIMS = {
    "trigger": ("content", "teacher", "learner_hypothesis", "unknown"),
    "teaching_action": ("teacher", "unknown"),
    "board_action": ("board", "unknown"),
    "pedagogical_role": ("teacher", "unknown"),
    "expected_learner_change": ("learner_hypothesis", "unknown"),
    "learning_check": ("teacher", "unknown"),
    "remediation": ("teacher", "unknown"),
}
ROLES = ("definition", "progressive_scaffolding", "representation_switch", "comparison", "worked_example", "emphasis", "error_correction", "check", "other")
MOVES = ("introduce", "annotate", "connect", "contrast", "revise", "clear")


def yes(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def no(c: Column) -> Column:
    """True unless the condition is known to hold."""
    return ~yes(c)


def empty(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def bad_range(t: Column) -> Column:
    """Not 0 <= start < end."""
    return no((t["start"] >= 0) & (t["end"] > t["start"]))


def bad_region(r: Column) -> Column:
    eps = 1e-9
    return no((r["x"] >= 0) & (r["y"] >= 0) & (r["width"] > 0) & (r["height"] > 0) & (r["x"] + r["width"] <= 1 + eps) & (r["y"] + r["height"] <= 1 + eps))


def bad_polygon(points: Column) -> Column:
    return no((F.size(F.array_distinct(points)) >= 4) & ~F.exists(points, lambda p: no(p["x"].between(0, 1) & p["y"].between(0, 1))))


def bad_probability(p: Column) -> Column:
    """Given but outside [0, 1]."""
    return p.isNotNull() & no(p.between(0, 1))


def bad_asset(a: Column, required: bool = True) -> Column:
    wrong = no(safe_relative_uri(a["asset_uri"]) & a["sha256"].rlike(SHA))
    return wrong if required else a.isNotNull() & wrong


def repeats(items: Column) -> Column:
    return yes(F.size(items) != F.size(F.array_distinct(items)))


def covers(outer: Column, start: Column, end: Column) -> Column:
    return (outer["start"] <= start) & (end <= outer["end"])


def children(bundles: DataFrame, name: str) -> DataFrame:
    """(bundle_id, place, columns of the child...) with the bundle's source, duration and settings."""
    rows = bundles.select("bundle_id", F.col("source.source_video_id").alias("_video"), F.col("source.duration_seconds").alias("_duration"), F.col("config").alias("_config"), F.col("teacher_only_recording").alias("_teacher_only"), F.posexplode(name).alias("place", "child"))
    return rows.select("bundle_id", "place", "_video", "_duration", "_config", "_teacher_only", "child.*")


def report(rows: DataFrame, entity: str, id_: str, rules: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*(F.when(yes(bad), F.lit(code)) for code, bad in rules.items())))
    return rows.select("bundle_id", F.lit(entity).alias("entity"), F.col(id_).alias("entity_id"), F.explode(codes).alias("code"))


def lookup(rows: DataFrame, table: DataFrame, on: str, id_: str, name: str, *columns: str) -> DataFrame:
    """``rows`` with struct column ``name`` of the row of ``table`` that ``on`` names (null where there is none; of repeated ids the first)."""
    own = table.groupBy("bundle_id", F.col(id_).alias(on)).agg(F.min_by(F.struct(F.col(id_).alias("id"), *columns), "place").alias(name))
    return rows.join(own.hint("merge"), ["bundle_id", on], "left")


def gather(rows: DataFrame, table: DataFrame, refs: str, key: str, id_: str, name: str, *columns: str) -> DataFrame:
    """``rows`` with array column ``name``: for each reference of ``refs``, struct(ref, found, columns...)."""
    targets = table.groupBy("bundle_id", F.col(id_).alias("ref")).agg(F.min_by(F.struct(*columns), "place").alias("_t"))
    asked = rows.select("bundle_id", "place", F.posexplode(refs).alias("_i", "ref"))
    told = asked.join(targets.hint("merge"), ["bundle_id", "ref"], "left").groupBy("bundle_id", "place").agg(F.array_sort(F.collect_list(F.struct("_i", "ref", F.col("_t").isNotNull().alias("found"), F.col("_t").alias("t")))).alias(name))
    shape = told.schema[name].dataType
    return rows.join(told.hint("merge"), ["bundle_id", "place"], "left").withColumn(name, F.coalesce(name, F.array().cast(shape)))


def evidence_rules(refs: Column, asked: Column, video: Column, kinds: tuple[str, ...] | None = None, surface: Column | None = None) -> dict[str, Column]:
    """Rules of evidence references, from ``gather``ed evidence (kind, source_video_id, target_surface)."""
    found = lambda bad: F.exists(refs, lambda r: r["found"] & bad(r["t"]))
    same = lambda t: t["source_video_id"] == video
    rules = {
        "evidence_ref.duplicate": repeats(asked),
        "evidence_ref.missing": F.exists(refs, lambda r: ~r["found"]),
        "evidence_ref.source": found(lambda t: no(same(t))),
    }
    if kinds:
        rules["evidence_ref.kind"] = found(lambda t: yes(same(t)) & no(t["kind"].isin(*kinds)))
    if surface is not None:
        right_kind = (lambda t: yes(same(t)) & yes(t["kind"].isin(*kinds))) if kinds else (lambda t: yes(same(t)))
        rules["evidence_ref.surface"] = found(lambda t: right_kind(t) & t["kind"].isin("frame", "board_state", "board_delta") & no(t["target_surface"] == surface))
    return rules


def bundle_issues(bundles: DataFrame) -> DataFrame:
    """Issue rows of every bundle; a valid one has none."""
    t = {name: children(bundles, name) for name in CHILDREN}
    surfaces, frames, objects, states, deltas, speech, evidence, transitions, learners = t.values()
    out = []

    # Evidence with what it points to.
    spot = lambda c: F.struct(F.col(c).alias("start"), F.col(c).alias("end"))
    same = lambda c: F.struct(F.col(f"{c}.start").cast("double").alias("start"), F.col(f"{c}.end").cast("double").alias("end"))
    kinds = [(frames, "frame", "frame_id", spot("timestamp"), F.col("surface_id")), (states, "board_state", "state_id", same("stable_during"), F.col("surface_id")), (deltas, "board_delta", "delta_id", same("time"), F.col("surface_id")), (speech, "speech", "speech_id", same("time"), F.lit(None).cast("string"))]
    targets = reduce(DataFrame.unionByName, [df.select("bundle_id", F.lit(kind).alias("kind"), F.col(i).alias("target_id"), time.alias("target_time"), s.alias("target_surface"), "place") for df, kind, i, time, s in kinds])
    targets = targets.groupBy("bundle_id", "kind", "target_id").agg(F.min_by(F.struct("target_time", "target_surface"), "place").alias("_target"))
    known = evidence.join(targets.hint("merge"), ["bundle_id", "kind", "target_id"], "left").withColumns({"has_target": F.col("_target").isNotNull(), "target_time": F.col("_target.target_time"), "target_surface": F.col("_target.target_surface")}).drop("_target")
    ev = ("kind", "source_video_id", "target_id", "target_surface", "target_time", "evidence_level", "asset")
    with_evidence = lambda df: gather(df, known, "evidence_refs", "place", "evidence_id", "_ev", *ev)
    refs, asked = F.col("_ev"), F.col("evidence_refs")
    c = F.col

    def common(prefix: str, time: Column | None = None) -> dict[str, Column]:
        rules = {"source.mismatch": no(c("source_video_id") == c("_video"))}
        if time is not None:
            rules |= {"time.range": bad_range(time), "time.duration": time["end"] > c("_duration")}
        return rules

    def in_order(df: DataFrame, value: Column) -> DataFrame:
        return df.withColumn("_prior", F.max(value).over(Window.partitionBy("bundle_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))

    surface = lambda df: lookup(df, surfaces, "surface_id", "surface_id", "_surface", "valid_during", "status")
    status = {"status.value": no(c("status").isin(*STATUSES))}

    # Ids and the bundle itself.
    ids = reduce(DataFrame.unionByName, [df.select("bundle_id", F.lit(entity).alias("entity"), F.col(i).alias("entity_id")) for (entity, i), df in zip(CHILDREN.values(), t.values(), strict=True)])
    within = ids.groupBy("bundle_id", "entity", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    out.append(within.where("n > 1").select("bundle_id", "entity", "entity_id", F.concat("entity", F.lit(".duplicate")).alias("code")))
    across = ids.groupBy("bundle_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out.append(across.select("bundle_id", F.lit("bundle").alias("entity"), "entity_id", F.lit("bundle.id_collision").alias("code")))
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    out.append(report(bundles, "bundle", "bundle_id", {
        "bundle.surface_empty": size("surfaces") == 0, "bundle.frame_empty": size("frames") == 0, "bundle.state_empty": size("states") == 0,
        "bundle.schema_version": no(c("schema_version") == "temporal-board-v2"), "bundle.payload_sha256": no(c("payload_sha256").rlike(SHA)), "bundle.immutable": no(c("immutable")),
        "source.duration": no(c("source.duration_seconds") > 0), "asset.value": bad_asset(c("source.video")), "config.roi": bad_polygon(c("config.board_roi")),
        "bundle.fabricated_learner": F.coalesce(c("teacher_only_recording"), F.lit(True)) & (size("learner_observations") > 0),
    }))

    out.append(report(surfaces, "surface", "surface_id", common("surface", c("valid_during")) | status | {
        "surface.kind": no(c("kind").isin("chalkboard", "whiteboard", "digital_ink", "unknown")), "surface.calibration": no(c("calibration").isin("manual", "auto_confirmed")),
        "polygon.value": bad_polygon(c("polygon")), "region.value": F.exists("ignore_regions", bad_region),
    }))

    rows = in_order(surface(frames), c("timestamp"))
    out.append(report(rows, "frame", "frame_id", common("frame") | {
        "frame.surface_ref": c("_surface").isNull(), "time.point": no((c("timestamp") >= 0) & (c("timestamp") <= c("_duration"))), "frame.order": c("timestamp") < c("_prior"),
        "frame.surface_time": no(c("timestamp").between(c("_surface.valid_during.start"), c("_surface.valid_during.end"))) & c("_surface").isNotNull(),
        "asset.value": bad_asset(c("source_asset")) | bad_asset(c("board_asset"), False) | bad_asset(c("ink_mask"), False) | bad_asset(c("occlusion_mask"), False),
        "probability.value": bad_probability(c("registration_score")) | bad_probability(c("visible_fraction")),
    }))

    rows = with_evidence(surface(objects))
    inside = lambda r: yes(covers(F.struct(c("first_visible").alias("start"), c("last_visible").alias("end")), r["t"]["target_time"]["start"], r["t"]["target_time"]["end"]))
    out.append(report(rows, "object", "object_id", common("object") | evidence_rules(refs, asked, c("source_video_id"), ("frame", "board_state"), c("surface_id")) | {
        "object.surface_ref": c("_surface").isNull(), "object.kind": no(c("kind").isin("text", "formula", "diagram", "arrow", "mark", "unknown")), "region.value": bad_region(c("region")),
        "object.semantic_source": no(c("semantic_source").isin("ocr", "vlm", "human", "none")), "object.semantic_without_source": (c("semantic_source") == "none") & c("semantic_text").isNotNull(),
        "object.time_order": c("last_visible") < c("first_visible"), "object.surface_time": c("_surface").isNotNull() & no(covers(c("_surface.valid_during"), c("first_visible"), c("last_visible"))),
        "object.evidence_empty": size(asked) == 0,
        "object.evidence_time": F.exists(refs, lambda r: r["found"] & r["t"]["target_time"].isNotNull() & r["t"]["kind"].isin("frame", "board_state") & ~inside(r)),
    }))

    obj = ("source_video_id", "surface_id", "first_visible", "last_visible")
    rows = gather(with_evidence(in_order(surface(states), c("stable_during.start"))), objects, "object_ids", "place", "object_id", "_obj", *obj)
    held = c("_obj")
    scope = lambda r: (r["t"]["source_video_id"] == c("source_video_id")) & (r["t"]["surface_id"] == c("surface_id"))
    accepted = c("status") == "accepted"
    out.append(report(rows, "state", "state_id", common("state", c("stable_during")) | status | evidence_rules(refs, asked, c("source_video_id"), ("frame",), c("surface_id")) | {
        "state.surface_ref": c("_surface").isNull(), "state.order": c("stable_during.start") < c("_prior"), "state.surface_time": c("_surface").isNotNull() & no(covers(c("_surface.valid_during"), c("stable_during.start"), c("stable_during.end"))),
        "asset.value": bad_asset(c("representative_asset")) | bad_asset(c("visibility_asset"), False), "state.object_duplicate": repeats(c("object_ids")),
        "state.object_ref": F.exists(held, lambda r: ~r["found"]), "state.object_scope": F.exists(held, lambda r: r["found"] & no(scope(r))),
        "state.object_time": F.exists(held, lambda r: r["found"] & yes(scope(r)) & no((r["t"]["first_visible"] <= c("stable_during.start")) & (r["t"]["last_visible"] >= c("stable_during.end")))),
        "state.observed_support": no(c("observed_support").between(0, 1)), "state.evidence_empty": size(asked) == 0,
        "state.evidence_time": F.exists(refs, lambda r: r["found"] & (r["t"]["kind"] == "frame") & r["t"]["target_time"].isNotNull() & no(covers(c("stable_during"), r["t"]["target_time"]["start"], r["t"]["target_time"]["end"]))),
        "state.accepted_surface_status": accepted & no(c("_surface.status") == "accepted"), "state.accepted_support": accepted & no(c("observed_support") > 0),
        "state.minimum_stable": accepted & (c("stable_during.end") - c("stable_during.start") < c("_config.minimum_stable_seconds")),
    }))

    st = ("source_video_id", "surface_id", "stable_during", "object_ids", "status")
    rows = gather(with_evidence(in_order(surface(deltas), c("time.start"))), objects, "affected_object_ids", "place", "object_id", "_obj", *obj)
    rows = lookup(lookup(rows, states, "before_state_id", "state_id", "_before", *st), states, "after_state_id", "state_id", "_after", *st)
    rows = rows.withColumn("_support", c("erase_evidence.supporting_frame_ids"))
    rows = gather(rows, frames, "_support", "place", "frame_id", "_frames", "source_video_id", "surface_id", "timestamp", "visible_fraction")
    none = F.array().cast("array<string>")
    before_ids, after_ids = F.coalesce(c("_before.object_ids"), none), F.coalesce(c("_after.object_ids"), none)
    before, after = (lambda i: F.array_contains(before_ids, i)), (lambda i: F.array_contains(after_ids, i))
    affected, time, op, erase = c("affected_object_ids"), c("time"), c("operation"), c("erase_evidence")
    any_ = lambda test: F.exists(affected, test)
    during = lambda x: x.between(time["start"], time["end"])
    appears = lambda r: r["found"] & no(during(r["t"]["first_visible"]))
    leaves = lambda r: r["found"] & no(during(r["t"]["last_visible"]))
    new, old = (lambda i: ~before(i) & after(i)), (lambda i: before(i) & ~after(i))
    kept = F.filter(affected, lambda i: before(i) & after(i))
    mod, rel = c("modification"), c("relation")
    anchors = F.concat(F.coalesce(rel["source_object_ids"], none), F.coalesce(rel["target_object_ids"], none))
    fr = c("_frames")
    both = c("_before").isNotNull() & c("_after").isNotNull()
    horizon = F.array_max(F.transform(fr, lambda f: f["t"]["timestamp"]))
    core = [c(f"confidence.{k}") for k in ("visibility", "registration", "persistence", "operation")]
    every = [*core, *(c(f"confidence.{k}") for k in ("ocr", "speech_alignment", "pedagogical_inference"))]
    is_ = lambda name: op == name
    out.append(report(rows, "delta", "delta_id", common("delta", time) | status | evidence_rules(refs, asked, c("source_video_id"), ("frame", "board_state"), c("surface_id")) | {
        "delta.surface_ref": c("_surface").isNull(), "delta.order": time["start"] < c("_prior"), "delta.surface_time": c("_surface").isNotNull() & no(covers(c("_surface.valid_during"), time["start"], time["end"])),
        "delta.before_ref": c("_before").isNull(), "delta.after_ref": c("_after").isNull(), "delta.same_state": c("before_state_id") == c("after_state_id"),
        "delta.state_scope": both & no((c("_before.source_video_id") == c("source_video_id")) & (c("_after.source_video_id") == c("source_video_id")) & (c("_before.surface_id") == c("surface_id")) & (c("_after.surface_id") == c("surface_id"))),
        "delta.temporal_order": both & no((c("_before.stable_during.end") <= time["start"]) & (c("_after.stable_during.start") >= time["end"])),
        "delta.operation": no(op.isin("add", "erase", "modify", "connect", "move", "unknown")), "region.value": bad_region(c("region")), "delta.object_duplicate": repeats(affected),
        "delta.object_ref": F.exists("_obj", lambda r: ~r["found"]), "delta.object_scope": F.exists("_obj", lambda r: r["found"] & no(scope(r))), "delta.object_empty": (op != "unknown") & (size(affected) == 0),
        "asset.value": bad_asset(c("delta_mask")) | bad_asset(c("comparison_asset")), "probability.value": reduce(lambda a, b: a | b, map(bad_probability, every)), "delta.evidence_empty": size(asked) == 0,
        "add.before_object": is_("add") & any_(before), "add.after_object": is_("add") & any_(lambda i: ~after(i)), "add.first_visible": is_("add") & F.exists("_obj", appears),
        "move.object_persistence": is_("move") & any_(lambda i: ~before(i) | ~after(i)), "move.unverifiable": is_("move") & accepted,
        "modify.state_change": is_("modify") & no(any_(before) & any_(after) & any_(lambda i: before(i) != after(i))),
        "modify.old_last_visible": is_("modify") & F.exists("_obj", lambda r: old(r["ref"]) & leaves(r)), "modify.new_first_visible": is_("modify") & F.exists("_obj", lambda r: new(r["ref"]) & appears(r)),
        "modify.relation_missing": is_("modify") & mod.isNull(), "modify.semantic_slot_id": is_("modify") & mod.isNotNull() & empty(mod["semantic_slot_id"]),
        "modify.relation_empty": is_("modify") & mod.isNotNull() & ((size(mod["old_object_ids"]) == 0) | (size(mod["new_object_ids"]) == 0)),
        "modify.old_object": is_("modify") & F.exists(mod["old_object_ids"], lambda i: ~F.array_contains(affected, i) | ~old(i)), "modify.new_object": is_("modify") & F.exists(mod["new_object_ids"], lambda i: ~F.array_contains(affected, i) | ~new(i)),
        "delta.unexpected_modification": (op != "modify") & mod.isNotNull(),
        "connect.state_change": is_("connect") & no(any_(new) & (F.size(F.array_distinct(kept)) >= 2)), "connect.first_visible": is_("connect") & F.exists("_obj", lambda r: new(r["ref"]) & appears(r)),
        "connect.relation_missing": is_("connect") & rel.isNull(), "connect.relation_type": is_("connect") & rel.isNotNull() & empty(rel["relation_type"]),
        "connect.relation_anchors": is_("connect") & rel.isNotNull() & ((size(rel["source_object_ids"]) == 0) | (size(rel["target_object_ids"]) == 0) | (F.size(F.array_distinct(anchors)) < 2)),
        "connect.relation_object": is_("connect") & rel.isNotNull() & F.exists(anchors, lambda i: ~F.array_contains(affected, i) | ~before(i) | ~after(i)),
        "delta.unexpected_relation": (op != "connect") & rel.isNotNull(),
        "erase.evidence_missing": is_("erase") & erase.isNull(), "erase.visibility": is_("erase") & erase.isNotNull() & no(erase["visibility_restored"]), "erase.after_absence": is_("erase") & erase.isNotNull() & no(erase["absent_from_after_state"]),
        "erase.confirmed_until": is_("erase") & erase.isNotNull() & erase["confirmed_until"].isNull(), "erase.persistence": is_("erase") & (erase["confirmed_until"] < c("_after.stable_during.end")),
        "erase.minimum_stable": is_("erase") & (erase["confirmed_until"] - time["end"] < c("_config.minimum_stable_seconds")), "erase.support_empty": is_("erase") & erase.isNotNull() & (size("_support") == 0),
        "erase.frame_ref": is_("erase") & F.exists(fr, lambda f: ~f["found"]), "erase.frame_scope": is_("erase") & F.exists(fr, lambda f: f["found"] & no(scope(f))),
        "erase.frame_time": is_("erase") & F.exists(fr, lambda f: f["found"] & no(f["t"]["timestamp"] >= time["end"])), "erase.frame_visibility": is_("erase") & F.exists(fr, lambda f: f["found"] & no(f["t"]["visible_fraction"] > 0)),
        "erase.support_horizon": is_("erase") & erase["confirmed_until"].isNotNull() & no(horizon >= erase["confirmed_until"]),
        "erase.before_object": is_("erase") & any_(lambda i: ~before(i)), "erase.after_object": is_("erase") & any_(after), "erase.last_visible": is_("erase") & F.exists("_obj", leaves),
        "erase.before_lifecycle": is_("erase") & F.exists("_obj", lambda r: r["found"] & (r["t"]["last_visible"] < c("_before.stable_during.end"))),
        "delta.unexpected_erase_evidence": (op != "erase") & erase.isNotNull(),
        "delta.accepted_operation": accepted & no(op.isin("add", "erase", "modify", "connect")), "delta.accepted_state_status": accepted & no((c("_before.status") == "accepted") & (c("_after.status") == "accepted")),
        "delta.accepted_confidence": accepted & c("confidence").isNotNull() & reduce(lambda a, b: a | b, (x.isNull() for x in core)),
    }))

    rows = in_order(speech, c("time.start"))
    out.append(report(rows, "speech", "speech_id", common("speech", c("time")) | {
        "speech.order": c("time.start") < c("_prior"), "speech.raw_text": empty(c("raw_text")), "speech.normalization": no(c("normalization").isin("none", "lexicon", "human")),
        "speech.untracked_normalization": (c("normalization") == "none") & c("normalized_text").isNotNull(), "speech.segment_indexes": (size("source_segment_indexes") == 0) | F.exists("source_segment_indexes", lambda i: no(i >= 0)),
    }))

    out.append(report(known, "evidence", "evidence_id", common("evidence", c("time")) | {
        "evidence.kind": no(c("kind").isin("frame", "board_state", "board_delta", "speech")), "evidence.target_id": empty(c("target_id")), "evidence.target_ref": ~c("has_target") & c("kind").isin("frame", "board_state", "board_delta", "speech") & ~empty(c("target_id")),
        "region.value": c("region").isNotNull() & bad_region(c("region")), "asset.value": bad_asset(c("asset"), False), "evidence.level": no(c("evidence_level").isin("observable", "teacher_stated", "inferred", "unknown")),
        "evidence.frame_level": (c("kind") == "frame") & (c("evidence_level") != "observable"), "evidence.board_level": c("kind").isin("board_state", "board_delta") & (c("evidence_level") != "observable"), "evidence.speech_level": (c("kind") == "speech") & (c("evidence_level") != "teacher_stated"),
        "evidence.time_mismatch": (c("time.end") < c("target_time.start")) | (c("time.start") > c("target_time.end")),
    }))

    out.append(report(with_evidence(learners), "learner_observation", "observation_id", common("learner_observation", c("time")) | evidence_rules(refs, asked, c("source_video_id"), ("frame", "speech")) | {"learner_observation.value": empty(c("value")), "learner_observation.evidence_empty": size(asked) == 0}))

    dl = ("time", "status", "comparison_asset")
    rows = gather(gather(with_evidence(transitions), deltas, "delta_ids", "place", "delta_id", "_deltas", *dl), speech, "speech_ids", "place", "speech_id", "_speech", "time")
    only_teacher = F.coalesce(c("_teacher_only"), F.lit(True))
    moves = c("executable_board_moves")
    steps = F.transform(moves, lambda m: m["step"])
    outside = lambda items: F.exists(items, lambda r: r["found"] & no(covers(c("time"), r["t"]["time"]["start"], r["t"]["time"]["end"])))
    shows = lambda kind, i: F.exists(refs, lambda r: r["found"] & (r["t"]["kind"] == kind) & (r["t"]["target_id"] == i))
    panel = lambda d: F.exists(refs, lambda r: r["found"] & (r["t"]["kind"] == "board_delta") & (r["t"]["target_id"] == d["ref"]) & (r["t"]["asset"]["asset_uri"] == d["t"]["comparison_asset"]["asset_uri"]) & (r["t"]["asset"]["sha256"] == d["t"]["comparison_asset"]["sha256"]))
    out.append(report(rows, "transition", "transition_id", common("transition", c("time")) | status | evidence_rules(refs, asked, c("source_video_id")) | {
        "transition.delta_duplicate": repeats(c("delta_ids")), "transition.speech_duplicate": repeats(c("speech_ids")), "transition.delta_ref": F.exists("_deltas", lambda r: ~r["found"]), "transition.speech_ref": F.exists("_speech", lambda r: ~r["found"]),
        "transition.delta_time": outside("_deltas"), "transition.speech_time": outside("_speech"),
        "transition.pedagogical_role": c("pedagogical_role.value").isNotNull() & no(c("pedagogical_role.value").isin(*ROLES)), "transition.learner_response_subject": c("observed_learner_response").isNotNull() & no(c("observed_learner_response.subject") == "learner_observed"),
        "transition.fabricated_learner": only_teacher & c("observed_learner_response").isNotNull(), "transition.moves": moves.isNull(), "transition.move_step": repeats(steps) | F.exists(steps, lambda s: no(s >= 1)), "transition.move_operation": F.exists(moves, lambda m: no(m["operation"].isin(*MOVES))),
        "transition.move_text": F.exists(moves, lambda m: empty(m["pedagogical_target"]) | empty(m["render_instruction"])), "transition.move_delta_empty": F.exists(moves, lambda m: size(m["source_delta_ids"]) == 0),
        "transition.move_delta_ref": F.exists(moves, lambda m: F.size(F.array_except(m["source_delta_ids"], c("delta_ids"))) > 0),
        "transition.accepted_delta": accepted & (size("delta_ids") == 0), "transition.accepted_speech": accepted & (size("speech_ids") == 0), "transition.accepted_delta_status": accepted & F.exists("_deltas", lambda r: no(r["t"]["status"] == "accepted")),
        "transition.accepted_delta_evidence": accepted & F.exists("delta_ids", lambda i: ~shows("board_delta", i)), "transition.accepted_delta_asset": accepted & F.exists("_deltas", lambda d: shows("board_delta", d["ref"]) & ~panel(d)),
        "transition.accepted_speech_evidence": accepted & F.exists("speech_ids", lambda i: ~shows("speech", i)),
    }))

    # Claims: one row for each slot of each transition.
    slots = [F.struct(F.lit(s).alias("slot"), c(s).alias("claim")) for s in (*CLAIMS, "observed_learner_response")]
    rows = transitions.select("bundle_id", F.col("place").alias("_of"), "transition_id", "source_video_id", "_teacher_only", F.explode(F.array(*slots)).alias("s"))
    rows = rows.where("s.claim is not null or s.slot <> 'observed_learner_response'").withColumn("place", F.concat_ws("/", "_of", "s.slot")).withColumns({"evidence_refs": c("s.claim.evidence_refs"), "claim": c("s.claim"), "slot": c("s.slot")})
    rows = with_evidence(rows)
    claim = c("claim")
    stated, level, who = claim["value"].isNotNull(), claim["level"], claim["subject"]
    supported = lambda test: F.exists(refs, lambda r: r["found"] & test(r["t"]))
    allowed = reduce(lambda a, b: a | b, ((c("slot") == s) & who.isin(*subjects) for s, subjects in CLAIMS.items()), c("slot") == "observed_learner_response")
    out.append(report(rows, "transition", "transition_id", evidence_rules(refs, asked, c("source_video_id")) | {
        "claim.type": claim.isNull(), "claim.subject": claim.isNotNull() & no(who.isin("board", "teacher", "content", "learner_hypothesis", "learner_observed", "unknown")), "claim.level": claim.isNotNull() & no(level.isin("observable", "teacher_stated", "inferred", "unknown")),
        "probability.value": bad_probability(claim["confidence"]), "claim.evidence_empty": stated & (level != "unknown") & (size(asked) == 0), "claim.null_level": claim.isNotNull() & ~stated & (level != "unknown"),
        "claim.unknown_value": (level == "unknown") & stated, "claim.unknown_subject": (level == "unknown") & (who != "unknown"), "claim.hypothesis_observable": (who == "learner_hypothesis") & (level == "observable"),
        "claim.observable_support": stated & (level == "observable") & ~supported(lambda e: (e["evidence_level"] == "observable") & e["kind"].isin("frame", "board_state", "board_delta")),
        "claim.teacher_stated_support": stated & (level == "teacher_stated") & ~supported(lambda e: (e["evidence_level"] == "teacher_stated") & (e["kind"] == "speech")),
        "claim.subject_slot": claim.isNotNull() & no(allowed), "transition.fabricated_learner_claim": F.coalesce(c("_teacher_only"), F.lit(True)) & (who == "learner_observed") & (c("slot") != "observed_learner_response"),
    }))
    return reduce(DataFrame.unionByName, out).distinct()


def validity(bundles: DataFrame, issues: DataFrame) -> DataFrame:
    """(bundle_id, n_issues, valid)."""
    n = issues.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_issues"))
    return bundles.select("bundle_id").join(n.hint("merge"), "bundle_id", "left").select("bundle_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.col("n_issues").isNull().alias("valid"))
