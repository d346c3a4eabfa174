"""Compiling accepted decisions into evidence bundles.

A bundle's arrays are taken apart, rows meet the decisions that name them, and what changed is put back in its order; documents never
leave the engine. What stands against a decision gives issue rows, and a bundle with one is not compiled. All tables grow with the
bundles, so joins are merges of shuffles: none is broadcast through the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import canonical_json
from tallyspark.sources.schemas import ASSET, SPEECH
from tallyspark.sources.tables import materialise

# Warnings of drafts, and those of what is compiled; the code that an aligned transcript settles.
DRAFTS = ("Independent annotator B draft", "All reviewable artifacts remain", "No independent ASR/transcript exists")
COMPILED = ("engineering_gold_dev_not_paper_gold", "agent_assisted_adjudication_requires_human_signoff")
SETTLED = "no_independent_asr"
UNKNOWN_CLAIM = "named_struct('value', CAST(NULL AS STRING), 'subject', 'unknown', 'level', 'unknown', 'confidence', CAST(NULL AS DOUBLE), 'evidence_refs', CAST(array() AS array<string>))"


def spoken(decisions: DataFrame, segments: DataFrame, ledgers: DataFrame) -> DataFrame:
    """``decisions`` with start, end and raw_text of the segments that they name, in their order, moved by the ledger's offset, and missing (how many there are not)."""
    asked = decisions.select("bundle_id", "ordinal", F.posexplode("segments").alias("_i", "index"))
    told = asked.join(segments.withColumnRenamed("index", "_index").hint("merge"), (asked["bundle_id"] == segments["bundle_id"]) & (F.col("index") == F.col("_index")), "left").select(asked["bundle_id"], "ordinal", "_i", "start", "end", "text", F.col("_index").isNull().alias("_lost"))
    told = told.groupBy("bundle_id", "ordinal").agg(
        F.min_by("start", "_i").alias("start"), F.max_by("end", "_i").alias("end"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda s: s["text"])).alias("raw_text"), F.count_if("_lost").alias("missing")
    )
    rows = decisions.join(told.hint("merge"), ["bundle_id", "ordinal"], "left").join(ledgers.select("bundle_id", "offset").hint("merge"), "bundle_id", "left")
    number = F.when(F.col("ordinal") > 99, F.col("ordinal").cast("string")).otherwise(F.lpad(F.col("ordinal").cast("string"), 2, "0"))
    named = {"speech_id": F.concat(F.lit("GOLD-SPEECH-"), number), "evidence_id": F.concat(F.lit("GOLD-EV-SPEECH-"), number)}
    return rows.withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset"), "missing": F.coalesce("missing", F.lit(0))} | named).drop("offset")


def decision_faults(bundles: DataFrame, decisions: DataFrame) -> DataFrame:
    """(bundle_id, ordinal, code) of decisions (``spoken``) that their bundle does not bear."""
    part = lambda name, *columns: bundles.select("bundle_id", F.explode(name).alias("c")).select("bundle_id", *columns).dropDuplicates(["bundle_id", columns[0].split(".")[-1]])
    settings = bundles.select("bundle_id", F.lit(True).alias("_bundle"), F.col("config.speech_window_seconds").alias("_reach"), F.col("source.duration_seconds").alias("_duration"))
    deltas = part("deltas", "c.delta_id", "c.before_state_id", "c.after_state_id", "c.surface_id", "c.time")
    states = bundles.select("bundle_id", F.explode("states").alias("c")).select("bundle_id", F.col("c.state_id").alias("_id"), F.col("c.representative_asset.sha256").alias("_sha")).dropDuplicates(["bundle_id", "_id"])
    surfaces = bundles.select("bundle_id", F.explode("surfaces").alias("c")).select("bundle_id", F.col("c.surface_id"), F.lit(True).alias("_surface")).distinct()
    rows = decisions.join(settings.hint("merge"), "bundle_id", "left").join(deltas.withColumn("_delta", F.lit(True)).hint("merge"), ["bundle_id", "delta_id"], "left")
    rows = rows.join(part("transitions", "c.transition_id", "c.delta_ids").hint("merge"), ["bundle_id", "transition_id"], "left")
    for side in ("before", "after"):
        rows = rows.join(states.select("bundle_id", F.col("_id").alias(f"{side}_state_id"), F.col("_sha").alias(f"_{side}"), F.lit(True).alias(f"_{side}_found")).hint("merge"), ["bundle_id", f"{side}_state_id"], "left")
    rows = rows.join(surfaces.hint("merge"), ["bundle_id", "surface_id"], "left")
    frames = bundles.select("bundle_id", F.explode("frames.frame_id").alias("_frame")).distinct().withColumn("_taken", F.lit(True))
    rows = rows.withColumn("_frame", F.col("frame.frame_id")).join(frames.hint("merge"), ["bundle_id", "_frame"], "left")
    nth = lambda c: F.row_number().over(Window.partitionBy("bundle_id", c).orderBy("ordinal"))
    rows = rows.withColumns({"_nth_id": nth("frame.frame_id"), "_nth_sha": nth("frame.sha256")})
    c, has, given = F.col, (lambda x: F.coalesce(F.col(x), F.lit(False))), F.col("frame").isNotNull()
    at = c("frame.timestamp")
    finite = at.isNotNull() & ~F.isnan(at) & (F.abs(at) != float("inf"))
    whole = has("_delta") & c("delta_ids").isNotNull()
    rules = {
        "reference.bundle": ~has("_bundle"),
        "reference.delta": ~has("_delta"),
        "reference.transition": c("delta_ids").isNull(),
        "transition.delta": whole & ~F.array_contains("delta_ids", c("delta_id")),
        "registration.range": ~c("registration").between(0, 1),
        "segment.empty": F.size("segments") < 1,
        "segment.missing": c("missing") > 0,
        "delta.chain": has("_delta") & ~(has("_before_found") & has("_after_found") & has("_surface")),
        "frame.time": given & ~finite,
        "frame.duplicate": given & (has("_taken") | (c("_nth_id") > 1)),
        "frame.window": given & finite & whole & ~at.between(F.greatest(F.lit(0.0), c("time.start") - c("_reach")), F.least(c("_duration"), c("time.end") + c("_reach"))),
        "frame.reused": given & (c("_nth_sha") > 1),
        "frame.static": given & (c("frame.sha256") == c("_after")),
    }
    unsure = ("registration.range", "segment.empty")  # null counts as a fault
    codes = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(code in unsure)), F.lit(code)) for code, bad in rules.items())))
    return rows.select("bundle_id", "ordinal", F.explode(codes).alias("code"))


def changed(bundles: DataFrame, name: str, id_: str, changes: DataFrame, update: Callable[[Column], dict[str, Column]], rest: str | None) -> DataFrame:
    """(bundle_id, ``name``): the child array with the fields of ``update`` where ``changes`` (bundle_id, ``id_``, columns) names a child; others get the status ``rest``."""
    rows = bundles.select("bundle_id", F.posexplode_outer(name).alias("_place", "_child")).withColumn(id_, F.col(f"_child.{id_}"))
    rows = rows.join(changes.withColumn("_hit", F.lit(True)).hint("merge"), ["bundle_id", id_], "left")
    hit, values, kind = F.coalesce("_hit", F.lit(False)), update(F.col("_child")), bundles.schema[name].dataType.elementType

    def part(path: str, field, old: Column) -> Column:
        """The field as it was or as it becomes: one struct for all changes, so that expressions do not nest."""
        if path in values:
            return F.when(hit, values[path]).otherwise(F.lit(rest) if path == "status" and rest else old).cast(field.dataType)
        if any(v.startswith(f"{path}.") for v in values):
            return F.when(hit | old.isNotNull(), F.struct(*(part(f"{path}.{x.name}", x, old[x.name]).alias(x.name) for x in field.dataType.fields)))
        return old

    new = F.struct(*(part(x.name, x, F.col(f"_child.{x.name}")).alias(x.name) for x in kind.fields))
    back = F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", new.alias("_child")))))
    return rows.groupBy("bundle_id").agg(F.transform(back, lambda x: x["_child"]).alias(name))


def addressed(asset: Column) -> Column:
    """An asset at the address of its content; the ending tells PNG from JPEG."""
    ending = F.when(F.lower(asset["asset_uri"]).endswith(".png"), ".png").otherwise(".jpg")
    return F.when(asset.isNotNull(), F.struct(F.when(asset["asset_uri"].isNotNull() & asset["sha256"].isNotNull(), F.concat(F.lit("assets/"), asset["sha256"], ending)).otherwise(asset["asset_uri"]).alias("asset_uri"), asset["sha256"].alias("sha256"))).otherwise(F.lit(None).cast(ASSET))


def judged(bundles: DataFrame, ledgers: DataFrame, decisions: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bundles with their ledgers, their decisions as ``spoken``, and what stands against these, of the inputs of ``compile_gold``.

    All three are written: documents are read a dozen times, and parsed or joined once."""
    frozen = materialise(bundles.join(ledgers.select("bundle_id", "adjudication_id", F.col("created_at").alias("_frozen")).hint("merge"), "bundle_id"), "bundles")
    said = materialise(spoken(decisions.join(frozen.select("bundle_id").hint("merge"), "bundle_id", "left_semi"), segments, ledgers), "said")
    return frozen, said, materialise(decision_faults(frozen, said), "faults")


def compile_gold(bundles: DataFrame, ledgers: DataFrame, decisions: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compiled bundles, and what stands against the others (bundle_id, ordinal, code).

    bundles: as ``schemas.BUNDLE``; ledgers: bundle_id, adjudication_id, created_at, offset (seconds of the transcript's clip); decisions:
    bundle_id, ordinal (1, 2 ...), delta_id, transition_id, semantic_label, normalized_speech, teaching_action, registration, segments
    (indexes), frame (frame_id, timestamp, asset_uri, sha256; or null); segments: bundle_id, index, start, end, text.

    Each decision makes a span of speech with its evidence, accepts its delta, states, surface and transition, may add a frame, and
    widens the transition's time to its speech; of several on one row the last says what is written. All else needs review again.
    Images move to the addresses of their content, and the payload's hash is that of the canonical JSON of all other fields."""
    frozen, said, faults = judged(bundles, ledgers, decisions, segments)
    bundles = materialise(frozen.join(faults.select("bundle_id").distinct().hint("merge"), "bundle_id", "left_anti"), "drafts")
    said = said.join(bundles.select("bundle_id").hint("merge"), "bundle_id", "left_semi")
    c = F.col
    last = lambda *keys: said.groupBy("bundle_id", *keys)
    pick = lambda name: F.max_by(name, "ordinal").alias(f"_{name}")

    deltas = last("delta_id").agg(pick("semantic_label"), pick("registration"))
    unsettled = lambda codes: F.filter(codes, lambda x: x != SETTLED)
    new_deltas = changed(bundles, "deltas", "delta_id", deltas, lambda d: {
        "semantic_label": c("_semantic_label"), "confidence.registration": c("_registration"), "confidence.speech_alignment": F.lit(1.0), "confidence.pedagogical_inference": F.lit(None).cast("double"),
        "uncertainty_codes": unsettled(d["uncertainty_codes"]), "status": F.lit("accepted"),
    }, "needs_review")
    ends = bundles.select("bundle_id", F.explode("deltas").alias("d")).join(deltas.select("bundle_id", c("delta_id").alias("_id")).hint("merge"), ["bundle_id"]).where("d.delta_id = _id")
    accepted = lambda _: {"status": F.lit("accepted")}
    states = ends.select("bundle_id", F.explode(F.array("d.before_state_id", "d.after_state_id")).alias("state_id")).distinct()
    new_states = changed(bundles, "states", "state_id", states, accepted, "needs_review")
    new_surfaces = changed(bundles, "surfaces", "surface_id", ends.select("bundle_id", c("d.surface_id").alias("surface_id")).distinct(), accepted, "needs_review")

    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", name))), lambda x: x[name])
    transitions = last("transition_id").agg(pick("speech_id"), pick("teaching_action"), pick("evidence_id"), F.min("start").alias("_start"), F.max("end").alias("_end"), in_order("evidence_id").alias("_refs"))
    claim = F.struct(c("_teaching_action").alias("value"), F.lit("teacher").alias("subject"), F.lit("teacher_stated").alias("level"), F.lit(1.0).alias("confidence"), F.array("_evidence_id").alias("evidence_refs"))
    new_transitions = changed(bundles, "transitions", "transition_id", transitions, lambda t: {
        "speech_ids": F.array("_speech_id"), "time": F.struct(F.least(t["time"]["start"], c("_start")).alias("start"), F.greatest(t["time"]["end"], c("_end")).alias("end")), "evidence_refs": F.array_distinct(F.concat(F.coalesce(t["evidence_refs"], F.array().cast("array<string>")), "_refs")),
        "teaching_action": claim, "pedagogical_role": F.expr(UNKNOWN_CLAIM), "uncertainty_codes": unsettled(t["uncertainty_codes"]), "status": F.lit("accepted"),
    }, "needs_review")

    place = said.join(ends.select("bundle_id", c("_id").alias("delta_id"), c("d.source_video_id").alias("_video"), c("d.surface_id").alias("_surface")).dropDuplicates(["bundle_id", "delta_id"]).hint("merge"), ["bundle_id", "delta_id"]).join(bundles.select("bundle_id", c("source.source_video_id").alias("_source")).hint("merge"), "bundle_id")
    time = F.struct("start", "end").alias("time")
    speech = F.struct("speech_id", c("_source").alias("source_video_id"), time, "raw_text", c("normalized_speech").alias("normalized_text"), F.lit("lexicon").alias("normalization"), c("segments").alias("source_segment_indexes"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    shape = {f.name: f.dataType.simpleString() for f in bundles.schema["evidence"].dataType.elementType.fields}
    evidence = F.struct("evidence_id", F.lit("speech").alias("kind"), c("speech_id").alias("target_id"), c("_source").alias("source_video_id"), time, none(shape["region"], "region"), none(shape["asset"], "asset"), F.lit("teacher_stated").alias("evidence_level"))
    frame = F.struct("frame.frame_id", c("_video").alias("source_video_id"), c("_surface").alias("surface_id"), "frame.timestamp", F.struct("frame.asset_uri", "frame.sha256").alias("source_asset"), *(none(ASSET, n) for n in ("board_asset", "ink_mask", "occlusion_mask")), none("double", "registration_score"), none("double", "visible_fraction"))
    made = place.groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "speech_id", speech.alias("s")))), lambda x: x["s"]).cast(f"array<{SPEECH}>").alias("_speech"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", evidence.alias("e")))), lambda x: x["e"]).alias("_evidence"),
        F.collect_list(F.when(c("frame").isNotNull(), frame)).alias("_frames"),
    )
    empty = lambda name: F.array().cast(bundles.schema[name].dataType)
    out = bundles.select(*[x for x in bundles.columns if x not in ("surfaces", "states", "deltas", "transitions")]).join(made.hint("merge"), "bundle_id", "left")
    for part in (new_surfaces, new_states, new_deltas, new_transitions):
        out = out.join(part.hint("merge"), "bundle_id")
    frames = F.concat(F.coalesce("frames", empty("frames")), F.coalesce(c("_frames").cast(bundles.schema["frames"].dataType), empty("frames")))
    by_time = F.transform(F.array_sort(F.transform(frames, lambda f: F.struct(f["timestamp"].alias("t"), f["frame_id"].alias("i"), f.alias("f")))), lambda x: x["f"])
    drafts = lambda w: reduce(lambda keep, start: keep & ~w.startswith(start), DRAFTS, w != COMPILED[0])

    def moved(name: str, items: Column, *assets: str) -> Column:
        fields = [x.name for x in bundles.schema[name].dataType.elementType.fields]
        return F.transform(items, lambda x: F.struct(*((addressed(x[n]) if n in assets else x[n]).alias(n) for n in fields)))

    out = out.withColumns({
        "frames": moved("frames", by_time, "source_asset", "board_asset", "ink_mask", "occlusion_mask"), "states": moved("states", c("states"), "representative_asset", "visibility_asset"), "deltas": moved("deltas", c("deltas"), "delta_mask", "comparison_asset"),
        "evidence": moved("evidence", F.concat("evidence", F.coalesce(c("_evidence").cast(bundles.schema["evidence"].dataType), empty("evidence"))), "asset"), "speech": F.coalesce("_speech", empty("speech")), "learner_observations": empty("learner_observations"),
        "warnings": F.concat(F.filter(F.coalesce("warnings", empty("warnings")), drafts), F.array(*map(F.lit, COMPILED))),
        "source": c("source").withField("video.asset_uri", F.lit("source/video.mp4")), "source_bundle_id": c("bundle_id"), "bundle_id": c("adjudication_id"), "created_at": c("_frozen"),
    })
    names = [x for x in bundles.columns if x not in ("adjudication_id", "_frozen", "payload_sha256")]
    out = out.select("source_bundle_id", *names).withColumn("payload_sha256", F.sha2(canonical_json(F.to_json(F.struct(*names))), 256))
    return out, faults
