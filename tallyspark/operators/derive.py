"""Derived evidence: projections of accepted rows, blind packages, evidence units, rater views and reviewer packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import hmac_sha256


def accepted_projection(rows: DataFrame, key: str, status: str, items: str, ids: DataFrame, allowed: DataFrame) -> DataFrame:
    """``rows`` that are accepted, whose key is in ``ids`` and that keep some of their ``items`` (an array, in order) in ``allowed``; one column each."""
    kept = rows.where(F.col(status) == "accepted").join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    parts = kept.select(key, F.posexplode(items).alias("_at", "_item")).join(allowed.select(F.col(allowed.columns[0]).alias("_item")).distinct(), "_item", "left_semi")
    left = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias(items))
    return kept.drop(items).join(left, key).select(*rows.columns)


def skill_listing(jobs: DataFrame, project: Column, deleted: DataFrame, kind: str = "distill", status: str = "completed") -> DataFrame:
    """(job_id, skill, updated_at) of the skills (array of names) of a project's finished jobs, without deleted ones (job_id, skill)."""
    rows = jobs.where(project & (F.col("kind") == kind) & (F.col("status") == status)).select("job_id", F.explode("skills").alias("skill"), "updated_at")
    return rows.join(deleted.select("job_id", "skill").distinct(), ["job_id", "skill"], "left_anti")


def first_valid(rows: DataFrame, key: Sequence[str], order: Sequence[str], valid: Column, n: int) -> DataFrame:
    """The first n rows of each key that are valid; a row that does not say counts as valid."""
    kept = rows.where(F.coalesce(valid, F.lit(True)))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_items(rows: DataFrame, key: Sequence[str], order: Sequence[str], items: str, n: int) -> DataFrame:
    """(key, item): the first n items of the arrays of a key's rows, taken in order."""
    each = rows.select(*key, *order, F.posexplode(items).alias("_at", "item"))
    return first_valid(each, key, [*order, "_at"], F.lit(True), n).select(*key, "item")


def by_collation(*columns: str) -> list[Column]:
    """Sort keys by the root collation of words: letters before their case, lower case first."""
    return [F.collate(F.col(c), "UNICODE") for c in columns]


def claims(response: dict[str, Column]) -> Column:
    """Ordered array of (pointer, content) of a response: operation, content and region of each action, then name and mechanism of its
    capability, the steps of its programme, and its evidence claims. Nulls among contents and regions are no claims."""
    item = lambda pointer, content: F.struct(pointer.alias("pointer"), content.alias("content"))
    at = lambda path, i, field="": F.concat(F.lit(f"/{path}/"), i.cast("string"), F.lit(field))
    fields = ("operation", "content", "region")
    actions = F.flatten(F.transform(response["actions"], lambda a, i: F.array(*(item(at("observed_board_actions", i, f"/{f}"), a[f]) for f in fields))))
    head = "/generalized_teaching_capability/"
    steps = F.transform(response["program"], lambda c, i: item(at("generalized_teaching_capability/action_program", i), c))
    said = F.transform(response["claims"], lambda c, i: item(at("evidence_claims", i, "/claim"), c))
    every = F.concat(actions, F.array(item(F.lit(f"{head}name"), response["name"]), item(F.lit(f"{head}mechanism"), response["mechanism"])), steps, said)
    return F.filter(every, lambda x: x["content"].isNotNull())


ARMS = ("transcript_only", "static_final_board", "uniform_frame", "oracle_delta")


def arm_evidence(arm: Column, final_board: Column, uniform_frame: Column, comparison: Column, operation: Column, label: Column) -> Column:
    """(mode, images, text) that a condition may show: speech alone, the board afterwards, one uniform frame, or the change itself."""
    images = F.when(arm == ARMS[1], F.array(final_board)).when(arm == ARMS[2], F.array(uniform_frame)).when(arm == ARMS[3], F.array(comparison)).otherwise(F.array().cast("array<string>"))
    mode = F.when(arm == ARMS[0], "text").when(arm == ARMS[3], "temporal_board").otherwise("static_frames")
    text = F.when(arm == ARMS[3], F.concat_ws(": ", operation, label)).otherwise("")
    return F.struct(mode.alias("mode"), images.alias("images"), text.alias("text"))


def blind_split(schedule: DataFrame, responses: DataFrame, sources: DataFrame, secret: bytes, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Public rows (blind_id, response, response_sha256), the private key (blind_id, request_id, case_id, arm, seed, source_id, teacher_id, response_sha256),
    and scheduled requests without a response or source (request_id, code).

    schedule: request_id, case_id, arm, seed, source_id; responses: request_id, response; sources: source_id, teacher_id. A blind id is
    the keyed hash of run and request, so nobody without the secret can tell pairs."""
    said = responses.select("request_id", "response", F.sha2("response", 256).alias("response_sha256"))
    rows = schedule.join(said, "request_id", "left").join(sources.select("source_id", "teacher_id"), "source_id", "left")
    whole = F.col("response").isNotNull() & F.col("teacher_id").isNotNull()
    blind = F.concat(F.lit("B-"), hmac_sha256(secret, F.concat(F.lit(f"{run}|"), F.col("request_id").cast("string"))))
    closed = rows.where(whole).withColumn("blind_id", blind)
    public = closed.select("blind_id", "response", "response_sha256")
    private = closed.select("blind_id", "request_id", "case_id", "arm", "seed", "source_id", "teacher_id", "response_sha256")
    code = F.when(F.col("response").isNull(), "response.missing").otherwise("source.missing")
    return public, private, rows.where(~whole).select("request_id", code.alias("code"))


def opaque_id(blind_id: Column, kind: str, index: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.left(F.sha2(F.concat_ws("|", blind_id, F.lit(kind), index.cast("string")), 256), F.lit(16)))


def evidence_units(items: DataFrame, events: DataFrame) -> DataFrame:
    """(blind_id, unit_id, kind, sequence_index, content): speech first, then a case's events in order.

    items: blind_id, case_id, speech; events: case_id, position, content."""
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("position"))
    board = items.select("blind_id", "case_id").join(events.select("case_id", "content", at.alias("sequence_index")), "case_id")
    rows = items.select("blind_id", F.lit("verified_speech_context").alias("kind"), F.lit(0).alias("sequence_index"), F.col("speech").alias("content")).unionByName(
        board.select("blind_id", F.lit("signed_gold_board_event").alias("kind"), "sequence_index", "content")
    )
    return rows.withColumn("unit_id", opaque_id(F.col("blind_id"), "evidence", F.col("sequence_index")))


def unit_pairs(units: DataFrame) -> DataFrame:
    """(blind_id, pair_id, before_unit_id, after_unit_id) of all board units of an item, earlier first; an item has few units by contract."""
    board = units.where(F.col("sequence_index") > 0)
    a = board.select("blind_id", F.col("sequence_index").alias("i"), F.col("unit_id").alias("before_unit_id"))
    b = board.select("blind_id", F.col("sequence_index").alias("j"), F.col("unit_id").alias("after_unit_id"))
    both = a.join(b, "blind_id").where("i < j")
    at = F.row_number().over(Window.partitionBy("blind_id").orderBy("i", "j")) - 1
    return both.withColumn("at", at).select("blind_id", opaque_id(F.col("blind_id"), "pair", F.col("at")).alias("pair_id"), "before_unit_id", "after_unit_id")


def denominators(units: DataFrame) -> DataFrame:
    """(blind_id, denominator_sha256, temporal_metric_status): the hash of what an item is rated against, without ids of its own."""
    line = F.concat_ws("|", "kind", F.sha2("content", 256))
    rows = units.groupBy("blind_id").agg(F.array_sort(F.collect_list(F.struct("sequence_index", line.alias("line")))).alias("x"), F.count_if(F.col("sequence_index") > 0).alias("n"))
    status = F.when(F.col("n") == 1, "not_applicable_single_event").otherwise("eligible_multi_edit")
    return rows.select("blind_id", F.sha2(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), 256).alias("denominator_sha256"), status.alias("temporal_metric_status"))


def applicable_pairs(rows: DataFrame, group: Sequence[str], events: str, metric: str) -> DataFrame:
    """``rows`` whose temporal metric counts nowhere in a group if any of its rows has a single event: the metric is null there, the rest stays."""
    single = rows.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg((F.min(events) <= 1).alias("_single"))
    both = rows.join(single, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    return both.withColumn(metric, F.when(~F.col("_single"), F.col(metric))).select(*rows.columns)


def rater_views(items: DataFrame, item: str, raters: Sequence[str], domain: str) -> DataFrame:
    """(rater, item, place): each rater's order of the same items, by a hash of domain, rater and item.

    Places are counted in two steps, by the hash's first digits and within them."""
    rows = items.select(F.explode(F.array(*map(F.lit, raters))).alias("rater"), F.col(item).alias("item"))
    rows = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(domain), "rater", "item"), 256)).withColumn("_d", F.left("_h", F.lit(3)))
    sums = rows.groupBy("rater", "_d").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select("rater", "_d", F.coalesce(F.sum("_n").over(Window.partitionBy("rater").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("rater", "_d").orderBy("_h", "item"))
    return rows.withColumn("_in", within).join(sums, ["rater", "_d"]).select("rater", "item", (F.col("_base") + F.col("_in") - 1).alias("place"))


def root_hash(rows: DataFrame, by: Sequence[str], line: Column) -> DataFrame:
    """(by, n, root): the hash of a group's lines in order of their own hashes, whatever order they come in."""
    leaf = F.sha2(line, 256)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("root"))


def card_manifest(groups: DataFrame, evidence: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, n_evidence, bytes, evidence_sha256, n_candidates) of review cards, zeros kept; evidence: key, path, sha256, bytes."""
    held = evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_evidence"), F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", "sha256"))), "\n"), 256).alias("evidence_sha256"),
    )
    out = groups.select(key).distinct().join(held, key, "left").join(candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates")), key, "left")
    return out.na.fill(0, ["n_evidence", "bytes", "n_candidates"])


def natural(text: Column) -> Column:
    """A sort key by which numbers inside a text go by their value, however many digits they have: each follows its own length, without leading zeros."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(plain(p)).cast("string"), 10, "0"), plain(p))).otherwise(p)), "")


def packet_issues(template: DataFrame, cards: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, code) where a reviewer's packet is not the cards one to one in order: card.missing, card.unknown, card.repeated, card.ordinal."""
    seen = template.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.min(ordinal).alias("_at"))
    both = seen.join(cards.select(key, F.col(ordinal).alias("_want")), key, "full")
    codes = F.array_compact(
        F.array(
            F.when(F.col("_times").isNull(), "card.missing"),
            F.when(F.col("_want").isNull(), "card.unknown"),
            F.when(F.col("_times") > 1, "card.repeated"),
            F.when(F.col("_at") != F.col("_want"), "card.ordinal"),
        )
    )
    return both.select(key, F.explode(codes).alias("code"))


def extend_intakes(parents: DataFrame, extensions: DataFrame, key: str) -> DataFrame:
    """``parents`` (key, frames, censored_at, decision) with the frames of their extensions (key, frames) behind their own, each once; a
    parent that is extended past its censoring point has none any more. Decisions are never made or changed."""
    more = extensions.select(key, F.explode("frames").alias("f")).groupBy(key).agg(F.array_sort(F.collect_set("f")).alias("_more"))
    rows = parents.join(more, key, "left")
    frames = F.array_distinct(F.concat("frames", F.coalesce("_more", F.slice("frames", 1, 0))))
    closed = F.col("censored_at").isNull() | (F.array_max("_more") > F.col("censored_at"))
    return rows.select(key, frames.alias("frames"), F.when(~F.coalesce(closed, F.lit(False)), F.col("censored_at")).alias("censored_at"), "decision")


def history_text(answer: Column, records: Column) -> Column:
    """An answer and, where there are any, a list of its board records (kind, title, summary)."""
    lines = F.array_join(F.transform(records, lambda r: F.concat(r["kind"], F.lit("「"), r["title"], F.lit("」："), r["summary"])), "\n")
    return F.concat_ws("\n\n", F.when(answer != "", answer), F.when(F.size(records) > 0, F.concat(F.lit("[本轮黑板记录]\n"), lines)))


def visible_answer(answer: Column, assumptions: Column, checks: Column, feedback: Column, instruction: Column) -> Column:
    """What a learner sees of an answer: its text, assumptions, feedback, checks, and the next step unless it is among the checks."""
    bullets = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    section = lambda title, body, there: F.when(there, F.concat(F.lit(title), body))
    next_one = F.trim(instruction)
    return F.concat_ws(
        "\n\n",
        F.when(F.trim(answer) != "", F.trim(answer)),
        section("学习前提：\n", bullets(assumptions), F.size(assumptions) > 0),
        section("对你刚才回答的反馈：\n", F.trim(feedback), F.trim(feedback) != ""),
        section("马上自检：\n", bullets(checks), F.size(checks) > 0),
        section("下一步：\n", next_one, (next_one != "") & ~F.array_contains(checks, next_one)),
    )


def assembled(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text, chunks, whole): a response's chunks joined in order, repeats of a number counted once; whole if none is missing from 0 on.

    A response is bounded by contract, so one key's chunks are one group."""
    once = chunks.groupBy(key, order).agg(F.min(text).alias("_t"))
    out = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_t"))).alias("x"), F.count(F.lit(1)).alias("chunks"), F.max(order).alias("last"))
    return out.select(key, F.array_join(F.transform("x", lambda c: c["_t"]), "").alias("text"), "chunks", (F.col("last") + 1 == F.col("chunks")).alias("whole"))
