"""Record sets that must cover each other exactly, and ledgers replayed into the snapshots that they were sealed with."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["plan", "rater", "item"]


def rating_closure(plans: DataFrame, assignments: DataFrame, ledger: DataFrame, ratings: DataFrame) -> DataFrame:
    """(plan, rater, item, code) where assignments, answers and sealed ratings do not cover each other exactly.

    plans: plan, sealed_at; assignments: plan, rater, item, place; ledger: plan, rater, item, sequence, recorded_at, sha; ratings: plan, rater,
    item, sha. Every assignment is answered once, in its place and before the plan is sealed, and its rating is the answer's. Rows of all
    three sets meet in one tagged union and one grouping by their key, so a record that any set lacks, has twice or has alone is seen there.
    A rater's sequence counts 1, 2, 3 ... without holes: that is told without item."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    at, sha = ledger.schema["recorded_at"].dataType, ledger.schema["sha"].dataType
    sets = [
        assignments.select(*KEY, F.lit("a").alias("of"), F.col("place").cast("long").alias("nth"), none(at, "recorded_at"), none(sha, "sha")),
        ledger.select(*KEY, F.lit("l").alias("of"), F.col("sequence").cast("long").alias("nth"), "recorded_at", "sha"),
        ratings.select(*KEY, F.lit("r").alias("of"), none("long", "nth"), none(at, "recorded_at"), F.col("sha").cast(sha).alias("sha")),
    ]
    of = lambda tag, value: F.when(F.col("of") == tag, value)
    met = reduce(DataFrame.unionByName, sets).groupBy(*KEY).agg(
        *(F.count(of(tag, F.lit(1))).alias(tag) for tag in "alr"), F.min(of("a", F.col("nth"))).alias("place"), F.min(of("l", F.col("nth"))).alias("sequence"), F.max(of("l", F.col("recorded_at"))).alias("at"), F.min(of("l", F.col("sha"))).alias("told"), F.min(of("r", F.col("sha"))).alias("kept"),
    )
    met = met.join(plans.groupBy("plan").agg(F.min("sealed_at").alias("sealed_at")), "plan", "left")
    a, answers, r = F.col("a"), F.col("l"), F.col("r")
    rules = {
        "assignment.repeated": a > 1,
        "entry.lost": (a > 0) & (answers == 0),
        "entry.foreign": (a == 0) & (answers > 0),
        "entry.repeated": answers > 1,
        "entry.order": (a > 0) & (answers > 0) & (F.col("place") != F.col("sequence")),
        "entry.late": (answers > 0) & (F.col("at") > F.col("sealed_at")),
        "plan.unknown": F.col("sealed_at").isNull(),
        "rating.lost": (answers > 0) & (r == 0),
        "rating.foreign": (answers == 0) & (r > 0),
        "rating.repeated": r > 1,
        "rating.changed": (answers > 0) & (r > 0) & ~F.col("told").eqNullSafe(F.col("kept")),
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items())))
    runs = ledger.groupBy("plan", "rater").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_distinct("sequence").alias("own"))
    holes = runs.where((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("own") != F.col("n"))).select("plan", "rater", F.lit(None).cast(assignments.schema["item"].dataType).alias("item"), F.lit("sequence.holes").alias("code"))
    return met.select(*KEY, F.explode(codes).alias("code")).unionByName(holes)


def rating_report(plans: DataFrame, assignments: DataFrame, ledger: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row a plan: what was assigned, answered and rated, issues, and whether it is closed: all of it, without any issue."""
    count = lambda rows, name: rows.groupBy("plan").agg(F.count(F.lit(1)).alias(name))
    out = plans.select("plan").distinct()
    for rows, name in ((assignments, "assigned"), (ledger, "answered"), (ratings, "rated"), (rating_closure(plans, assignments, ledger, ratings), "issues")):
        out = out.join(count(rows, name), "plan", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("closed", (F.col("assigned") > 0) & (F.col("issues") == 0))


# The arms of an item.
ARMS = ("transcript_only", "static_final_board", "uniform_frame", "oracle_delta")


def projection(units: DataFrame) -> DataFrame:
    """(item, arm, n_units, sha): the hash over an arm's units (item, arm, place, sha) in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "sha"))), lambda x: x["sha"])
    return units.groupBy("item", "arm").agg(F.count(F.lit(1)).alias("n_units"), F.sha2(F.array_join(ordered, "\n"), 256).alias("sha"))


def public_issues(private: DataFrame, public: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """(item, arm, code) where what is published is not what the private derivation gives.

    private: item, arm, place, sha (units); public: item, arm, n_units, sha. An item publishes each of ``arms`` once and no other, and each with
    the hash of its own units in their order: a unit that is missing, added, changed or moved is seen by the hash alone."""
    told = projection(private).select("item", "arm", F.col("n_units").alias("_n"), F.col("sha").alias("_sha"))
    shown = public.groupBy("item", "arm").agg(F.count(F.lit(1)).alias("times"), F.min("n_units").alias("n_units"), F.min("sha").alias("sha"))
    both = told.join(shown, ["item", "arm"], "full")
    known = F.col("arm").isin(*arms)
    rules = {
        "arm.unknown": ~F.coalesce(known, F.lit(False)),
        "public.missing": F.col("times").isNull(),
        "public.foreign": F.col("_n").isNull(),
        "public.repeated": F.col("times") > 1,
        "units.count": F.col("n_units") != F.col("_n"),
        "projection.sha": ~F.col("sha").eqNullSafe(F.col("_sha")) & F.col("times").isNotNull() & F.col("_n").isNotNull(),
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items())))
    held = both.groupBy("item").agg(F.collect_set(F.when(known, F.col("arm"))).alias("_held"))
    lacking = held.select("item", F.explode(F.array_except(F.array(*map(F.lit, arms)), "_held")).alias("arm"), F.lit("arm.missing").alias("code"))
    return both.select("item", "arm", F.explode(codes).alias("code")).unionByName(lacking)


def entry_digest(request: Column, state: Column, sha: Column) -> Column:
    """The first 48 bits of an entry's hash as a number. A snapshot's digest is their sum: it needs no order, and entries can be taken out of it again."""
    text = F.concat_ws("|", request.cast("string"), state, F.coalesce(sha, F.lit("")))
    return F.conv(F.left(F.sha2(text, 256), F.lit(12)), 16, 10).cast("long")


def replay(events: DataFrame, heads: DataFrame, states: Sequence[str]) -> DataFrame:
    """(run_id, generation, a count a state, requests, digest): what each checkpoint of a run must hold.

    events: run_id, request_id, seq, at, state, sha; heads: run_id, generation, created_at. A checkpoint holds each request's latest
    state of those up to its time. Each event takes its request's former entry out and puts the new one in, in the first checkpoint that
    sees it; these differences are summed by checkpoint, and added up along the checkpoints alone. So neither requests nor events are
    repeated for each checkpoint, and events of one run need not meet in one task. States outside ``states`` count in requests and digest."""
    former = lambda c: F.lag(c).over(Window.partitionBy("run_id", "request_id").orderBy("at", "seq"))
    rows = events.select("run_id", "request_id", "seq", "at", "state", "sha").withColumns({"_state": former("state"), "_sha": former("sha"), "_first": F.row_number().over(Window.partitionBy("run_id", "request_id").orderBy("at", "seq")) == 1})
    entry = lambda state, sha, n: F.struct(F.col(state).alias("state"), F.lit(n).alias("n"), (n * entry_digest(F.col("request_id"), F.col(state), F.col(sha))).alias("digest"))
    moves = rows.select("run_id", "at", F.explode(F.array_compact(F.array(entry("state", "sha", 1), F.when(~F.col("_first"), entry("_state", "_sha", -1))))).alias("m")).select("run_id", "at", "m.*")
    order = Window.partitionBy("run_id").orderBy("created_at", "generation")
    placed = heads.select("run_id", "generation", "created_at").withColumn("i", F.row_number().over(order) - 1)
    times = placed.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "created_at"))), lambda x: x["created_at"]).alias("times"))
    seen = moves.join(times, "run_id").withColumn("i", F.size(F.filter("times", lambda t: t < F.col("at")))).where(F.col("i") < F.size("times"))
    named = [F.sum(F.when(F.col("state") == s, F.col("n"))).alias(f"_{s}") for s in states]
    sums = seen.groupBy("run_id", "i").agg(*named, F.sum("n").alias("_requests"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("_digest"))
    along = Window.partitionBy("run_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = [F.coalesce(F.sum(f"_{c}").over(along), F.lit(0)).cast("decimal(38,0)" if c == "digest" else "long").alias(c) for c in (*states, "requests", "digest")]
    return placed.join(sums, ["run_id", "i"], "left").select("run_id", "generation", *upto)


def replay_issues(events: DataFrame, heads: DataFrame, states: Sequence[str]) -> DataFrame:
    """(run_id, generation, code) where a checkpoint (run_id, generation, created_at, a count a state, requests, digest) is not what its run's events give."""
    told = replay(events, heads, states)
    names = (*states, "requests", "digest")
    both = heads.select("run_id", "generation", *names).join(told.select("run_id", "generation", *(F.col(c).alias(f"_{c}") for c in names)), ["run_id", "generation"])
    codes = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"snapshot.{c}")) for c in names)))
    return both.select("run_id", "generation", F.explode(codes).alias("code"))
