"""Agreement of two annotators: label counts, confusion, Cohen's kappa, summaries and the reliability gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.quantiles import percentiles


def _domain(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    values = ", ".join("('" + x.replace("'", "''") + "')" for x in labels)
    return rows.sparkSession.sql(f"SELECT label FROM VALUES {values} AS v(label)")


def label_counts(rows: DataFrame, raters: dict[str, str], labels: Sequence[str]) -> DataFrame:
    """(rater, label, n) for each rater's column over a fixed domain; labels that are never used count 0."""
    told = F.explode(F.array(*(F.struct(F.lit(name).alias("rater"), F.col(c).cast("string").alias("label")) for name, c in raters.items()))).alias("r")
    counts = rows.select(told).select("r.*").groupBy("rater", "label").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*map(F.lit, raters))).alias("rater")
    return _domain(rows, labels).select("label", names).join(counts, ["rater", "label"], "left").select("rater", "label", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(rows: DataFrame, left: str, right: str, labels: Sequence[str]) -> DataFrame:
    """(left_label, right_label, n) over the square of a fixed domain, zeros kept."""
    counts = rows.groupBy(F.col(left).cast("string").alias("left_label"), F.col(right).cast("string").alias("right_label")).agg(F.count(F.lit(1)).alias("n"))
    square = _domain(rows, labels).select(F.col("label").alias("left_label"), F.explode(F.array(*map(F.lit, labels))).alias("right_label"))
    return square.join(counts, ["left_label", "right_label"], "left").select("left_label", "right_label", F.coalesce("n", F.lit(0)).alias("n"))


def kappa(rows: DataFrame, left: Column, right: Column, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa over the labels that occur: items, observed and expected agreement, status and value.

    Whether it is estimable is decided in whole numbers: the sum of products of margins against items squared."""
    pairs = rows.select(*by, left.cast("string").alias("l"), right.cast("string").alias("r")).groupBy(*by, "l", "r").agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("l").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("r").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("m")
    margins = pairs.select(*by, side).select(*by, "m.*").groupBy(*by, "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("chance"))
    whole = pairs.groupBy(*by).agg(F.sum("n").alias("items"), F.coalesce(F.sum(F.when(F.col("l") == F.col("r"), F.col("n"))), F.lit(0)).alias("same"))
    out = whole.join(chance, list(by)) if by else whole.join(chance)
    square = F.col("items") * F.col("items")
    observed, expected = F.col("same") / F.col("items"), F.col("chance") / square
    fixed = F.col("chance") == square
    return out.where("items > 0").select(
        *by,
        "items",
        observed.alias("observed"),
        expected.alias("expected"),
        F.when(fixed, "not_estimable").otherwise("estimable").alias("status"),
        F.when(~fixed, F.try_divide(F.col("same") * F.col("items") - F.col("chance"), square - F.col("chance"))).alias("kappa"),
    )


def sequence_label(accepted: Column, operations: Column) -> Column:
    """One label for a decision's operations in order, or for none accepted."""
    return F.when(accepted, F.concat(F.lit("ACCEPT:"), F.array_join(operations, ">"))).otherwise("NO_EVENT_ACCEPTED")


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, median (middle pair averaged) and maximum; nulls where there is no value."""
    whole = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))
    middle = percentiles(rows, by, value, (0.5,)).select(*(F.col(k).alias(f"_{k}") for k in by), F.col(value).alias("median"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] or F.lit(True)
    return whole.join(middle, same, "left").select(*by, "n", "mean", "median", "maximum")


def agreement_rate(rows: DataFrame, same: Column, by: Sequence[str] = ()) -> DataFrame:
    """Items, agreements, rate, conflicts and conflict rate."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if(same).alias("agreed"))
    return out.withColumn("rate", F.try_divide(F.col("agreed"), F.col("items"))).withColumn("conflicts", F.col("items") - F.col("agreed"))


def reliability_gate(first: Column, second: Column) -> Column:
    """Decision from the two primary kappas (null: not estimable)."""
    least = F.least(first, second)
    return (
        F.when(first.isNull() | second.isNull(), "BLOCKED_PRIMARY_KAPPA_NOT_ESTIMABLE")
        .when(least < 0.67, "RELABEL_PILOT_REQUIRED")
        .when(least < 0.8, "CONTINUE_FULL_CONFLICT_ADJUDICATION")
        .otherwise("TARGET_RELIABILITY_MET")
    )


def reconciliation_status(decision: Column, conflicts: Column) -> Column:
    """What a reconciliation may do next; no state writes a gold set."""
    return (
        F.when(decision == "BLOCKED_PRIMARY_KAPPA_NOT_ESTIMABLE", "reliability_gate_blocked_no_gold_written")
        .when(decision == "RELABEL_PILOT_REQUIRED", "relabel_pilot_required_no_gold_written")
        .when(conflicts > 0, "joint_human_resolution_required_no_gold_written")
        .otherwise("ready_for_joint_human_confirmation_no_gold_written")
    )


def reviewer_join(left: DataFrame, right: DataFrame, key: str, scientific: Sequence[str]) -> DataFrame:
    """(key, agreed): two reviewers' rows by card, agreed where all scientific columns are equal, nulls included; a card that one lacks is a conflict."""
    a = left.select(key, F.struct(*scientific).alias("_left"), F.lit(True).alias("_has_left"))
    b = right.select(key, F.struct(*scientific).alias("_right"), F.lit(True).alias("_has_right"))
    both = a.join(b, key, "full")
    return both.select(key, (F.coalesce("_has_left", F.lit(False)) & F.coalesce("_has_right", F.lit(False)) & F.col("_left").eqNullSafe(F.col("_right"))).alias("agreed"))


def boundary_deltas(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, start_delta, end_delta) of events that both reviewers accepted, matched by event id."""
    a = left.select(*key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    return a.join(right, list(key)).select(*key, F.abs(F.col("_s") - F.col("start")).alias("start_delta"), F.abs(F.col("_e") - F.col("end")).alias("end_delta"))
