"""Append-only ledgers: hash chains, checkpoint transitions, rollups and derived counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import derived_id, js_number


def domain_hash(domain: str, payload: Column) -> Column:
    """SHA-256 of the domain, a zero character and the payload."""
    return F.sha2(F.concat(F.lit(domain), F.lit("\0"), payload), 256)


def chain_issues(rows: DataFrame, key: Sequence[str], revision: str, parent: str, signature: str, payload: Column, domain: str) -> DataFrame:
    """(key, revision, code): entries of each chain whose revision skips, whose parent is not the one before's signature, or
    whose signature is not that of their payload and parent. Revisions count from 1; the first has no parent."""
    order = Window.partitionBy(*key).orderBy(revision)
    own = domain_hash(domain, F.concat_ws("|", F.coalesce(F.col(parent), F.lit("")), payload))
    rows = rows.withColumns({"_place": F.row_number().over(order), "_before": F.lag(signature).over(order)})
    codes = F.array_compact(
        F.array(
            F.when(F.col(revision) != F.col("_place"), "revision.skipped"),
            F.when(~F.col(parent).eqNullSafe(F.col("_before")), "parent.signature"),
            F.when(~F.col(signature).eqNullSafe(own), "signature.mismatch"),
        )
    )
    return rows.select(*key, revision, F.explode(codes).alias("code"))


def current(rows: DataFrame, key: Sequence[str], revision: str) -> DataFrame:
    """The last entry of each chain."""
    body = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(body, revision).alias("_r")).select(*key, "_r.*")


# Which states may follow which.
REQUEST_TRANSITIONS: dict[str, tuple[str, ...]] = {
    "PENDING": ("PENDING", "DISPATCH_INTENT_COMMITTED", "FAILED_CLOSED"),
    "RETRY_READY": ("RETRY_READY", "DISPATCH_INTENT_COMMITTED", "FAILED_CLOSED"),
    "DISPATCH_INTENT_COMMITTED": ("DISPATCH_INTENT_COMMITTED", "RECEIPT_COMMITTED", "BLOCKED_AMBIGUOUS", "FAILED_CLOSED"),
    "RECEIPT_COMMITTED": ("RECEIPT_COMMITTED", "RETRY_READY", "SCHEMA_VALIDATED_COMMITTED", "FAILED_CLOSED"),
    "SCHEMA_VALIDATED_COMMITTED": ("SCHEMA_VALIDATED_COMMITTED",),
    "BLOCKED_AMBIGUOUS": ("BLOCKED_AMBIGUOUS", "FAILED_CLOSED"),
    "FAILED_CLOSED": ("FAILED_CLOSED",),
}
RUN_TRANSITIONS: dict[str, tuple[str, ...]] = {
    "SEALED_READY": ("SEALED_READY", "RUNNING", "FAILED_CLOSED"),
    "RUNNING": ("RUNNING", "INTERRUPTED_SAFE", "BLOCKED_AMBIGUOUS", "FAILED_CLOSED", "EXECUTION_COMPLETE"),
    "INTERRUPTED_SAFE": ("INTERRUPTED_SAFE", "RUNNING", "FAILED_CLOSED"),
    "BLOCKED_AMBIGUOUS": ("BLOCKED_AMBIGUOUS", "FAILED_CLOSED"),
    "FAILED_CLOSED": ("FAILED_CLOSED",),
    "EXECUTION_COMPLETE": ("EXECUTION_COMPLETE",),
}


def may_follow(before: Column, after: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """Whether a state may follow another; an unknown state follows nothing."""
    ways = reduce(lambda out, item: out.when(before == item[0], after.isin(*item[1])), list(allowed.items())[1:], F.when(before == next(iter(allowed)), after.isin(*next(iter(allowed.values())))))
    return F.coalesce(ways, F.lit(False))


def transition_issues(rows: DataFrame, key: Sequence[str], order: str, state: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose state may not follow the one before it in its key, with that state."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(order))
    rows = rows.withColumn("previous_state", before)
    return rows.where(F.col("previous_state").isNotNull() & ~may_follow(F.col("previous_state"), F.col(state), allowed))


def checkpoint_issues(heads: DataFrame) -> DataFrame:
    """(run_id, generation, code) of a run's checkpoints: run_id, generation, previous_sha, sha, created_at, run_state, request_count."""
    order = Window.partitionBy("run_id").orderBy("generation")
    lag = lambda c: F.lag(c).over(order)
    rows = heads.withColumns({f"_{c}": lag(c) for c in ("generation", "sha", "created_at", "run_state", "request_count")})
    later = F.col("_generation").isNotNull()
    codes = F.array_compact(
        F.array(
            F.when(~later & ((F.col("generation") != 0) | (F.col("run_state") != "SEALED_READY")), "generation.first"),
            F.when(later & (F.col("generation") != F.col("_generation") + 1), "generation.skipped"),
            F.when(later & ~F.col("previous_sha").eqNullSafe(F.col("_sha")), "chain.previous"),
            F.when(F.col("created_at") < F.col("_created_at"), "time.backwards"),
            F.when(F.col("request_count") != F.col("_request_count"), "request_count.drift"),
            F.when(later & ~may_follow(F.col("_run_state"), F.col("run_state"), RUN_TRANSITIONS), "run_state.transition"),
        )
    )
    return rows.select("run_id", "generation", F.explode(codes).alias("code"))


def entry_issues(entries: DataFrame) -> DataFrame:
    """(run_id, request_id, generation, code) of request entries over a run's checkpoints.

    entries: run_id, generation, request_id, idempotency_key, state, max_attempts, attempts_used, intent_sha, audit_sha."""
    order = Window.partitionBy("run_id", "request_id").orderBy("generation")
    names = ("idempotency_key", "state", "max_attempts", "attempts_used", "intent_sha", "audit_sha")
    rows = entries.withColumns({f"_{c}": F.lag(c).over(order) for c in ("generation", *names)})
    new, old = (lambda c: F.col(c)), (lambda c: F.col(f"_{c}"))
    same = lambda c: new(c).eqNullSafe(old(c))
    moved = lambda a, b: (old("state") == a) & new("state").isin(*([b] if isinstance(b, str) else b))
    all_same = reduce(lambda a, b: a & b, (same(c) for c in names))
    attempt = same("intent_sha") & new("audit_sha").isNotNull() & ~same("audit_sha") & (new("attempts_used") == old("attempts_used") + 1)
    kept = same("intent_sha") & same("audit_sha") & same("attempts_used")
    rules = {
        "idempotency_key.drift": ~same("idempotency_key"),
        "max_attempts.drift": ~same("max_attempts"),
        "state.transition": ~may_follow(old("state"), new("state"), REQUEST_TRANSITIONS),
        "attempts.backwards": new("attempts_used") < old("attempts_used"),
        "provenance.rebound": same("state") & ~all_same,
        "dispatch.unclean": moved("PENDING", "DISPATCH_INTENT_COMMITTED") & ((new("attempts_used") != 0) | new("audit_sha").isNotNull()),
        "attempt.unbound": moved("DISPATCH_INTENT_COMMITTED", ["RECEIPT_COMMITTED", "BLOCKED_AMBIGUOUS", "FAILED_CLOSED"]) & ~attempt,
        "receipt.provenance": moved("RECEIPT_COMMITTED", ["RETRY_READY", "SCHEMA_VALIDATED_COMMITTED"]) & ~kept,
        "retry.provenance": moved("RETRY_READY", "DISPATCH_INTENT_COMMITTED") & (~same("audit_sha") | ~same("attempts_used") | same("intent_sha")),
        "fail_closed.unclean": moved("PENDING", "FAILED_CLOSED") & (new("intent_sha").isNotNull() | new("audit_sha").isNotNull() | (new("attempts_used") != 0)),
        "fail_closed.provenance": (new("state") == "FAILED_CLOSED") & ~old("state").isin("PENDING", "DISPATCH_INTENT_COMMITTED") & ~kept,
    }
    codes = F.array_compact(F.array(*(F.when(F.col("_generation").isNotNull() & F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items())))
    return rows.select("run_id", "request_id", "generation", F.explode(codes).alias("code"))


def state_histogram(rows: DataFrame, key: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """One column of counts for each known state, zeros kept."""
    return rows.groupBy(*key).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def count_issues(declared: DataFrame, rows: DataFrame, key: str, counters: Mapping[str, Column]) -> DataFrame:
    """(key, counter, declared, derived) where a declared counter is not what the rows give (0 without rows)."""
    derived = rows.groupBy(key).agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"_{n}") for n, c in counters.items()))
    both = declared.join(derived, key, "left")
    told = F.array(*(F.struct(F.lit(n).alias("counter"), F.col(n).cast("long").alias("declared"), F.coalesce(F.col(f"_{n}"), F.lit(0)).alias("derived")) for n in counters))
    return both.select(key, F.explode(told).alias("c")).select(key, "c.*").where(~F.col("declared").eqNullSafe(F.col("derived")))


def lesson_rollup(packages: DataFrame, video: str, package: str, start: str, end: str, events: str) -> DataFrame:
    """One lesson a video: its packages in order, window, counts, and an id from a hash of its content.

    ``packages`` columns: ids, window bounds and accepted events. The content is canonical: fields in name order, numbers as whole where they are."""
    content = F.concat(F.lit('{"events":'), js_number(F.sum(events)), F.lit(',"packages":["'), F.array_join(F.array_sort(F.collect_list(F.col(package).cast("string"))), '","'), F.lit('"]}'))
    out = packages.groupBy(video).agg(F.count(F.lit(1)).alias("n_packages"), F.min(start).alias("start"), F.max(end).alias("end"), F.sum(events).alias("events"), content.alias("_content"))
    return out.select(video, derived_id("lesson-", F.col("_content"), 16).alias("lesson_id"), "n_packages", "start", "end", "events")


def queue_rollup(groups: DataFrame, package: str, decided: Column, signed: Column, accepted: Column, ready_at: int = 30) -> DataFrame:
    """Counts of each package of a review queue, and whether all its groups are signed and its accepted events suffice."""
    out = groups.groupBy(package).agg(F.count(F.lit(1)).alias("groups"), F.count_if(decided).alias("decided"), F.count_if(signed).alias("signed"), F.coalesce(F.sum(accepted.cast("long")), F.lit(0)).alias("accepted"))
    return out.withColumn("ready", (F.col("signed") == F.col("groups")) & (F.col("accepted") >= ready_at))


def package_rollup(groups: DataFrame, package: str, start: str, end: str, signed_at: str, accepted: Column) -> DataFrame:
    """Window, accepted events and freeze time of each package."""
    return groups.groupBy(package).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count_if(accepted).alias("accepted"), F.max(signed_at).alias("frozen_at"), F.count(F.lit(1)).alias("groups"))


def revoked_pins(pins: DataFrame, revocations: DataFrame, sha: str) -> DataFrame:
    """Pins whose hash is on the revocation list."""
    return pins.join(revocations.select(sha).distinct(), sha, "left_semi")


def hash_order(rows: DataFrame, domain: str, slot: Column, card: Column, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with a reproducible presentation place: by the hash of domain, slot and card, ties by card."""
    rows = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(domain), slot.cast("string"), card.cast("string")), 256)).withColumn("_c", card)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_c"))).drop("_h", "_c")
