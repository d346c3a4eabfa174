"""Reviews: candidates and their blockers, decisions against frozen candidates, readiness, and suites against their sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.tables import materialise

# Fixed values.
UNKNOWN, UNWRITTEN = "unknown", "未转写"
REPLAYS = ("teacher_replay", "merged")
#: Seconds by which an accepted event may leave its group's window.
SLACK = 2


def blockers(start: Column, end: Column, operation: Column, label: Column, relation: Column, modification: Column, evidence: Column) -> Column:
    """Why a candidate cannot be accepted as it is: an array of codes, empty if nothing stands against it."""
    blank = F.coalesce(F.trim(label), F.lit("")).isin("", UNWRITTEN)
    return F.array_compact(
        F.array(
            F.when(start.isNull() | end.isNull(), "time.missing"),
            F.when(F.coalesce(operation, F.lit(UNKNOWN)) == UNKNOWN, "operation.unknown"),
            F.when(blank, "label.missing"),
            F.when((operation == "CONNECT") & relation.isNull(), "relation.missing"),
            F.when((operation == "MODIFY") & modification.isNull(), "modification.missing"),
            F.when(F.coalesce(evidence, F.lit(0)) == 0, "evidence.missing"),
        )
    )


def group_candidates(groups: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(group_id, operation, start, end, label, refs, ready, blockers): one candidate for each group with source events.

    Its time is the hull of theirs, its operation the only known one among theirs, its label the group's or the first one's.
    groups: group_id, label; events: group_id, event_id, position, operation, start, end, label; evidence: group_id, path."""
    known = F.collect_set(F.when(F.col("operation") != UNKNOWN, F.col("operation")))
    hull = events.groupBy("group_id").agg(
        known.alias("known"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", "position").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"]).alias("refs"),
    )
    rows = groups.join(hull, "group_id").join(evidence.groupBy("group_id").agg(F.count(F.lit(1)).alias("held")), "group_id", "left")
    operation = F.when(F.size("known") == 1, F.get("known", F.lit(0))).otherwise(UNKNOWN)
    label = F.coalesce(F.when(F.trim("label") != "", F.col("label")), "first", F.lit(UNWRITTEN))
    rows = rows.select("group_id", operation.alias("operation"), "start", "end", label.alias("label"), "refs", "held")
    none = F.lit(None).cast("string")
    rows = rows.withColumn("blockers", blockers(F.col("start"), F.col("end"), F.col("operation"), F.col("label"), none, none, F.col("held")))
    return rows.select("group_id", "operation", "start", "end", "label", "refs", (F.size("blockers") == 0).alias("ready"), "blockers")


def decision_issues(decisions: DataFrame, finals: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, event_id, code) of accepting decisions that do not follow their frozen candidates.

    decisions: group_id, disposition, selected (array of candidate ids); finals: group_id, event_id, refs, operation, start, end, label, relation;
    candidates: group_id, candidate_id, event_id, refs, operation, relation; groups: group_id, start, end. Selected candidates
    and final events must match one to one; operation, sources and relation are the candidate's, time lies in the group's window."""
    accepted = decisions.where("disposition = 'accept'")
    none = F.lit(None).cast(finals.schema["event_id"].dataType)
    unselected = accepted.where(F.coalesce(F.size("selected"), F.lit(0)) < 1).select("group_id", none.alias("event_id"), F.lit("decision.unselected").alias("code"))
    chosen = accepted.select("group_id", F.explode(F.array_distinct("selected")).alias("candidate_id")).join(candidates, ["group_id", "candidate_id"], "left")
    frozen = chosen.select("group_id", "event_id", F.col("refs").alias("_refs"), F.col("operation").alias("_operation"), F.col("relation").alias("_relation"), F.lit(True).alias("_chosen"))
    own = finals.join(accepted.select("group_id"), "group_id", "left_semi").withColumn("_final", F.lit(True))
    both = own.join(frozen, ["group_id", "event_id"], "full").join(groups.select("group_id", F.col("start").alias("_from"), F.col("end").alias("_to")), "group_id", "left")
    matched = F.col("_final").isNotNull() & F.col("_chosen").isNotNull()
    connect = F.col("operation") == "CONNECT"
    codes = F.array_compact(
        F.array(
            F.when(~matched, "decision.bijection"),
            F.when(matched & (F.array_sort("refs") != F.array_sort("_refs")), "event.refs"),
            F.when(matched & ((F.col("operation") == UNKNOWN) | ((F.col("_operation") != UNKNOWN) & (F.col("operation") != F.col("_operation")))), "event.operation"),
            F.when(F.col("_final") & ~(F.col("end") > F.col("start")), "event.time"),
            F.when(F.col("_final") & (F.col("_from").isNull() | (F.col("start") < F.col("_from") - SLACK) | (F.col("end") > F.col("_to") + SLACK)), "event.window"),
            F.when(F.col("_final") & (F.coalesce(F.trim("label"), F.lit("")) == ""), "event.label"),
            F.when(matched & ((connect & F.col("relation").isNull()) | (~connect & F.col("relation").isNotNull()) | ~F.col("relation").eqNullSafe(F.col("_relation"))), "event.relation"),
        )
    )
    return both.select("group_id", "event_id", F.explode(codes).alias("code")).unionByName(unselected)


def readiness(groups: DataFrame, evidence: DataFrame, packages: DataFrame, least_events: int) -> DataFrame:
    """One row: groups, decided, packages, signed, accepted, and the numbers of structural issues (groups without a window or comparison,
    reused comparisons, overlapping packages of one source) and of human ones (undecided groups, unsigned packages, missing events).

    groups: package_id, group_id, start, end, decided, accepted_events; evidence: group_id, kind, path, sha256; packages: package_id, source_id, signed.
    The comparison that counts is a group's first by path and hash."""
    first = evidence.where(F.lower("kind").contains("comparison")).groupBy("group_id").agg(F.min(F.struct("path", "sha256")).alias("c")).select("group_id", F.col("c.sha256").alias("sha256"))
    held = groups.join(first, "group_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = held.agg(
        F.count(F.lit(1)).alias("groups"), zero(F.count_if("decided")).alias("decided"), zero(F.sum("accepted_events")).alias("accepted"), zero(F.count_if(F.col("start").isNull())).alias("no_window"),
        zero(F.count_if(F.col("sha256").isNull())).alias("no_comparison"),
    )
    reused = held.where("sha256 is not null").groupBy("sha256").agg((F.count(F.lit(1)) - 1).alias("n")).agg(zero(F.sum("n")).alias("reused"))
    windows = groups.groupBy("package_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(F.col("start").isNull()).alias("open")).where("open = 0").join(packages, "package_id")
    before = F.lag("end").over(Window.partitionBy("source_id").orderBy("start", "package_id"))
    overlaps = windows.withColumn("before", before).agg(zero(F.count_if(F.col("before") > F.col("start"))).alias("overlapping"))
    signed = packages.agg(F.count(F.lit(1)).alias("packages"), zero(F.count_if("signed")).alias("signed"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), (reused, overlaps, signed), counted)  # one row each
    structural = F.col("no_window") + F.col("no_comparison") + F.col("reused") + F.col("overlapping")
    human = (F.col("groups") - F.col("decided")) + (F.col("packages") - F.col("signed")) + F.greatest(F.lit(least_events) - F.col("accepted"), F.lit(0))
    return row.select("groups", "decided", "packages", "signed", "accepted", "no_window", "no_comparison", "reused", "overlapping", structural.alias("structural_issues"), human.alias("human_issues"))


def missing_fields(row: Sequence[str], lists: Sequence[str], first: str = "") -> Column:
    """Names of the texts that are blank and the arrays that are empty."""
    blank = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in row]
    return F.array_compact(F.array(*blank, *(F.when(F.coalesce(F.size(c), F.lit(0)) < 1, F.lit(c)) for c in lists)))


def assessment_issues(assessments: DataFrame, cards: DataFrame, most: int = 10_000) -> DataFrame:
    """(reviewer, card, code): each reviewer answers every card once and in order (card.missing, card.unknown, card.repeated, card.ordinal),
    accepts with events (accept.events) and does nothing else with them (other.events).

    assessments: reviewer, card, ordinal, disposition, events (count); cards: card, ordinal. The answers wanted are reviewers times cards by
    contract: the reviewers, ``most`` at most (else an error), are set beside each card; cards are not broadcast."""
    seen = assessments.groupBy("reviewer", "card").agg(F.count(F.lit(1)).alias("times"), F.min("ordinal").alias("at"), F.min("disposition").alias("disposition"), F.min("events").alias("events"))
    reviewers = assessments.select("reviewer").distinct().limit(most + 1).collect()
    if len(reviewers) > most:
        raise ValueError(f"more than {most} reviewers")
    names = F.array(*[F.lit(r["reviewer"]) for r in reviewers]).cast(T.ArrayType(assessments.schema["reviewer"].dataType))
    wanted = cards.select(F.explode(names).alias("reviewer"), "card", F.col("ordinal").alias("want"))
    both = seen.join(wanted, ["reviewer", "card"], "full")
    accept = F.col("disposition") == "accept"
    codes = F.array_compact(
        F.array(
            F.when(F.col("times").isNull(), "card.missing"),
            F.when(F.col("want").isNull(), "card.unknown"),
            F.when(F.col("times") > 1, "card.repeated"),
            F.when(F.col("at") != F.col("want"), "card.ordinal"),
            F.when(accept & (F.col("events") < 1), "accept.events"),
            F.when(~accept & (F.col("events") > 0), "other.events"),
        )
    )
    return both.select("reviewer", "card", F.explode(codes).alias("code"))


#: Transitions of sources up to this many are broadcast; beyond it the join shuffles.
BROADCAST_TRANSITIONS = 500_000
#: References that one task takes, about. One that is asked for more than ``HOT`` times as often is dealt to several tasks.
REFERENCES_A_TASK, HOT = 200_000, 5


def beside(asked: DataFrame, marks: DataFrame, tasks: int) -> tuple[DataFrame, list[str]]:
    """Rows ``asked`` and ``marks`` (k and equal columns) dealt by k to ``tasks``, and the columns by which they are dealt.

    Where a k is asked for very often its asked rows are dealt by cap and action too, and its marks are sent to each of these tasks. The
    sketch that finds such keys, 500 at most, decides on the dealing alone."""
    most = HOT * REFERENCES_A_TASK
    top = asked.agg(F.expr("approx_top_k(k, 500, 10000)").alias("top")).first()["top"]
    hot = [(x["item"], x["count"] // REFERENCES_A_TASK + 1) for x in top or () if x["item"] is not None and x["count"] > most]
    by = ["k"]
    if hot:
        salts = F.broadcast(asked.sparkSession.createDataFrame(hot, T.StructType([T.StructField("k", asked.schema["k"].dataType), T.StructField("salts", T.LongType())])))
        by, n = ["k", "salt"], F.coalesce("salts", F.lit(1))
        asked = asked.join(salts, "k", "left").withColumn("salt", F.pmod(F.xxhash64("cap", "action"), n)).drop("salts")
        marks = marks.join(salts, "k", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("salts")
    return asked.unionByName(marks).repartition(tasks, *by), by


def suite(capabilities: DataFrame, actions: DataFrame) -> DataFrame:
    """(cap, transitions, evidence, actions): each capability with its actions as an array, those of an unknown capability without references of its own."""
    merged = lambda c: F.flatten(F.collect_list(c)).alias(c)
    whole = capabilities.groupBy("cap").agg(merged("transitions"), merged("evidence"))
    own = actions.groupBy("cap").agg(F.collect_list(F.struct("action", "origin", "transitions", "deltas", "evidence")).alias("actions"))
    return whole.join(own, "cap", "full")


def suite_issues(capabilities: DataFrame, actions: DataFrame, sources: DataFrame, visuals: DataFrame, submitted: DataFrame) -> DataFrame:
    """``nested_suite_issues`` of capabilities (cap, transitions, evidence) and actions (cap, action, origin, transitions, deltas, evidence)."""
    return nested_suite_issues(suite(capabilities, actions), sources, visuals, submitted)


def nested_suite_issues(suites: DataFrame, sources: DataFrame, visuals: DataFrame, submitted: DataFrame) -> DataFrame:
    """(cap, action, ref, code) where a suite does not rest on its source catalogue; action is null for the capability's own.

    suites: cap, transitions, evidence, actions (array of action, origin, transitions, deltas, evidence); sources: transition, deltas,
    evidence (accepted transitions); visuals: transition, delta, evidence (exact pictures of a change); submitted: evidence (shown to the model).
    All references are arrays of longs or strings of one kind. What a capability's references say of each other is told in its row.
    What its sources say is asked once for evidence and once for changes: a reference goes, with the transitions that its action uses, to
    the task that has the sources' rows of that evidence or change, and is told there. The tables that several rules read are written once."""
    suites, sources = materialise(suites, "suite-capabilities", compression="zstd"), materialise(sources, "suite-sources", compression="zstd")
    some = lambda c: F.coalesce(c, F.array())
    action_type = suites.schema["actions"].dataType.elementType["action"].dataType
    say = lambda rows, ref, code: rows.select("cap", "action", F.col(ref).cast("string").alias("ref"), F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"))

    def beyond(refs: Column, known: Column) -> Column:
        """Distinct references that are not among the known ones; one that is null is none of them."""
        return F.concat(F.array_except(F.array_compact(refs), known), F.filter(F.array_distinct(refs), lambda r: r.isNull()))

    whole = suites.select("cap", F.lit(None).cast(action_type).alias("action"), some(F.col("transitions")).alias("transitions"), some(F.col("evidence")).alias("evidence"))
    own = suites.select("cap", some(F.col("transitions")).alias("_transitions"), some(F.col("evidence")).alias("_evidence"), F.inline("actions"))
    own = own.withColumns({c: some(F.col(c)) for c in ("transitions", "evidence")})
    replay = F.coalesce(F.col("origin").isin(*REPLAYS), F.lit(False))
    both = own.select("cap", "action", "transitions", "evidence").unionByName(whole)
    used = some(F.flatten(F.transform("actions", lambda a: some(a["transitions"]))))
    refs = lambda rows, of, code: say(rows.select("cap", "action", F.explode(of).alias("ref")), "ref", code)

    uses = both.select("cap", "action", F.explode(F.array_distinct("transitions")).alias("transition"))
    origins = sources.select("transition").distinct()
    if origins.count() <= BROADCAST_TRANSITIONS:
        origins = F.broadcast(origins)

    # As many tasks as there are references of a kind, so that no task's share grows with the tables.
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    total = own.agg(n("evidence").alias("e"), n("deltas").alias("d")).first().asDict(), whole.agg(n("evidence").alias("e")).first().asDict(), sources.agg(n(some(F.col("evidence"))).alias("e"), n(some(F.col("deltas"))).alias("d")).first().asDict()
    tasks = {k: sum(x.get(k, 0) for x in total) // REFERENCES_A_TASK + 1 for k in ("e", "d")}

    # Evidence: what some source has is known; one of the transitions used has it, or it is out of scope.
    mark = sources.select(F.explode("evidence").alias("k"), F.array("transition").alias("ts"), F.lit(None).cast(suites.schema["cap"].dataType).alias("cap"), F.lit(None).cast(action_type).alias("action"), F.lit(True).alias("mark"))
    asked = both.select(F.explode(F.array_distinct("evidence")).alias("k"), F.array_distinct("transitions").alias("ts"), "cap", "action", F.lit(False).alias("mark"))
    rows, by = beside(asked, mark, tasks["e"])
    rows = rows.withColumn("known", F.max("mark").over(Window.partitionBy(*by)))
    rows = rows.select(*by, "cap", "action", "mark", "known", F.explode_outer("ts").alias("t")).withColumn("has", F.max("mark").over(Window.partitionBy(*by, "t")))
    told = rows.where("not mark").groupBy(*by, "cap", "action").agg(F.max(F.col("known") & F.col("k").isNotNull()).alias("known"), F.max(F.col("has") & F.col("t").isNotNull()).alias("has"))
    evidence = told.withColumn("code", F.when(~F.col("known"), "source.evidence_ref").when(~F.col("has"), "source.evidence_scope"))

    # Changes: likewise, and a replay cites and submits one of the pictures that the transitions used have of a change.
    sent = visuals.join(submitted.select("evidence").distinct().withColumn("sent", F.lit(True)), "evidence", "left")
    kinds = {"cap": suites.schema["cap"].dataType, "action": action_type, "cited": suites.schema["evidence"].dataType, "picture": visuals.schema["evidence"].dataType, "sent": T.BooleanType()}
    shape = lambda rows: rows.select("k", "ts", "kind", *(F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    asked = own.select("cap", "action", F.explode(F.array_distinct("deltas")).alias("k"), F.array_distinct("transitions").alias("ts"), F.when(replay, F.col("evidence")).alias("cited"), F.lit("asked").alias("kind"))
    marks = sources.select(F.explode("deltas").alias("k"), F.array("transition").alias("ts"), F.lit("source").alias("kind"))
    shown = sent.select(F.col("delta").alias("k"), F.array("transition").alias("ts"), F.col("evidence").alias("picture"), F.coalesce("sent", F.lit(False)).alias("sent"), F.lit("picture").alias("kind"))
    rows, by = beside(shape(asked), shape(marks).unionByName(shape(shown)), tasks["d"])
    rows, pair = rows.withColumn("t", F.explode_outer("ts")).drop("ts"), Window.partitionBy(*by, "t")
    rows = rows.withColumns({"has": F.max(F.col("kind") == "source").over(pair), "pictures": F.collect_set(F.when(F.col("kind") == "picture", F.struct("picture", "sent"))).over(pair)})
    met = F.col("k").isNotNull() & F.col("t").isNotNull()
    rows = rows.where("kind = 'asked'").select(*by, "cap", "action", F.col("cited").isNotNull().alias("replay"), (met & F.col("has")).alias("has"), (met & (F.size("pictures") > 0)).alias("seen"),
        (met & F.exists("pictures", lambda p: F.coalesce(F.array_contains("cited", p["picture"]), F.lit(False)))).alias("cited"), (met & F.exists("pictures", lambda p: p["sent"])).alias("sent"))
    told = rows.groupBy(*by, "cap", "action").agg(*(F.max(c).alias(c) for c in ("replay", "has", "seen", "cited", "sent")))
    picture = F.when(~F.col("seen"), "source.delta_visual_missing").when(~F.col("cited"), "action.delta_visual_ref").when(~F.col("sent"), "action.delta_visual_not_submitted")
    codes = F.array_compact(F.array(F.when(~F.col("has"), "source.delta_ref"), F.when(F.col("replay"), picture)))
    changes = told.select("cap", "action", "k", F.explode(codes).alias("code"))

    parts = [
        say(uses.join(origins, "transition", "left_anti"), "transition", "source.transition_ref"),
        refs(own, beyond(F.col("transitions"), F.col("_transitions")), "action.capability_transition"),
        refs(own, beyond(F.col("evidence"), F.col("_evidence")), "action.capability_evidence"),
        say(evidence.where("code is not null"), "k", F.col("code")),
        say(own.where(replay & (F.size("deltas") < 1)).withColumn("none", F.lit(None).cast("string")), "none", "action.replay_delta"),
        refs(suites.withColumn("action", F.lit(None).cast(action_type)), beyond(some(F.col("transitions")), used), "capability.unused_transition"),
        say(changes, "k", F.col("code")),
    ]
    return reduce(DataFrame.unionByName, parts)
