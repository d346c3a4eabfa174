"""Scores of rated items: evidence metrics, nested macro means, baselines, paired differences and decision rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1_or_null(precision: Column, recall: Column) -> Column:
    """Harmonic mean; null where either is null, 0 where both are 0."""
    total = precision + recall
    return F.when(total == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, total))


def rating_counts_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counted ratings, where an empty denominator counts as 1 (as rating sheets do)."""
    precision = F.when(tp + fp == 0, 1.0).otherwise(F.try_divide(tp, tp + fp))
    recall = F.when(tp + fn == 0, 1.0).otherwise(F.try_divide(tp, tp + fn))
    return precision, recall, f1_or_null(precision, recall)


def item_metrics(claims: DataFrame, eligible: DataFrame, edits: DataFrame, pairs: DataFrame, item: str = "item") -> DataFrame:
    """evidence_f1, edit_coverage, temporal_fidelity, unsupported_claim_rate of each item of ``claims``.

    claims (item, claim, supported, unit): a row for each claim and cited unit (unit null without one); eligible (item,
    n_units); edits (item, n_edits, n_covered); pairs (item, n_pairs, n_correct). Precision is supported claims over
    claims, recall distinct units cited by supported claims over eligible ones. A zero or missing denominator gives null."""
    by_claim = claims.groupBy(item).agg(
        F.count_distinct("claim").alias("n_claims"),
        F.count_distinct(F.when(F.col("supported"), F.col("claim"))).alias("n_supported"),
        F.count_distinct(F.when(F.col("supported"), F.col("unit"))).alias("n_cited"),
    )
    rows = reduce(lambda a, b: a.join(b, item, "left"), (eligible, edits, pairs), by_claim)
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    precision, recall = share("n_supported", "n_claims"), share("n_cited", "n_units")
    return rows.select(
        item,
        f1_or_null(precision, recall).alias("evidence_f1"),
        share("n_covered", "n_edits").alias("edit_coverage"),
        share("n_correct", "n_pairs").alias("temporal_fidelity"),
        F.try_divide((F.col("n_claims") - F.col("n_supported")).cast("double"), F.col("n_claims")).alias("unsupported_claim_rate"),
    )


def macro_mean(rows: DataFrame, levels: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Means of means: over rows, then up the ``levels`` from the last to the first; one row for each ``by``.

    Each level is a partial aggregation; after the first, the tables are as small as the cells they hold."""
    for depth in range(len(levels), -1, -1):
        rows = rows.groupBy(*by, *levels[:depth]).agg(*(F.avg(v).alias(v) for v in values))
    return rows


def rater_mean(ratings: DataFrame, item: Sequence[str], rater: str, values: Sequence[str], raters: int = 2) -> DataFrame:
    """Equal means over raters; ``complete`` is false (and means null) where an item lacks a rater or a value."""
    full = F.count_distinct(rater) == raters
    means = [F.when(full & (F.count(v) == F.count(F.lit(1))), F.avg(v)).alias(v) for v in values]
    return ratings.groupBy(*item).agg(full.alias("complete"), *means)


def argmax_with_order(scores: DataFrame, arm: str, score: str, tie_order: Sequence[str], within: float = 1e-15, by: Sequence[str] = ()) -> DataFrame:
    """The arm with the highest score; among those within ``within`` of it, the first in ``tie_order``. Arms outside it do not take part."""
    place = F.array_position(F.array(*map(F.lit, tie_order)), F.col(arm))
    rows = scores.withColumn("_place", place).where("_place > 0")
    rows = rows.withColumn("_top", F.max(score).over(Window.partitionBy(*by))).where(F.col(score) >= F.col("_top") - within)
    order = Window.partitionBy(*by).orderBy("_place")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*by, arm, score)


def paired_difference(rows: DataFrame, pair: Sequence[str], arm: str, value: str, left: str, right: str) -> DataFrame:
    """left - right of each pair that has both arms (mean, where an arm has several rows)."""
    pick = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    out = rows.where(F.col(arm).isin(left, right)).groupBy(*pair).agg(pick(left).alias("left_value"), pick(right).alias("right_value"))
    return out.where("left_value is not null and right_value is not null").withColumn("difference", F.col("left_value") - F.col("right_value"))


def arm_summary(rows: DataFrame, arm: str, values: Sequence[str], failure: Column, disagreement: Column) -> DataFrame:
    """n, means, failures and mean absolute rater disagreement of each arm."""
    return rows.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values), F.count_if(failure).alias("hard_failures"), F.avg(F.abs(disagreement)).alias("mean_absolute_disagreement")
    )


def case_deltas(differences: DataFrame, case: str, difference: str = "difference") -> DataFrame:
    """Mean difference of each case, and how many of its pairs are positive."""
    return differences.groupBy(case).agg(F.avg(difference).alias("mean_delta"), F.count_if(F.col(difference) > 0).alias("positive_pairs"), F.count(F.lit(1)).alias("pairs"))


def rating_issues(rows: DataFrame, key: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, code): ratings whose counts do not close or whose stated precision, recall and F1 are not those of the counts.

    rows: tp, fp, fn, units, evidence_claims, factual_claims, unsupported, precision, recall, f1."""
    precision, recall, f1 = rating_counts_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    counts = ("tp", "fp", "fn", "units", "evidence_claims", "factual_claims", "unsupported")
    far = lambda stated, own: F.coalesce(F.abs(F.col(stated) - own) > tolerance, F.lit(True))
    rules = {
        "count.negative": reduce(lambda a, b: a | b, (F.coalesce(F.col(c) < 0, F.lit(True)) for c in counts)),
        "count.denominator": F.col("tp") + F.col("fn") != F.col("units"),
        "count.claims": F.col("evidence_claims") > F.col("factual_claims"),
        "count.false_positive": F.col("fp") > F.col("evidence_claims"),
        "count.unsupported": (F.col("unsupported") < F.col("fp")) | (F.col("unsupported") > F.col("factual_claims")),
        "value.precision": far("precision", precision),
        "value.recall": far("recall", recall),
        "value.f1": far("f1", f1),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules.items())))
    return rows.select(*key, F.explode(found).alias("code"))


def matrix_issues(rows: DataFrame, cell: Sequence[str], arm: str, arms: Sequence[str], constant: Sequence[str] = ()) -> DataFrame:
    """(cell, code): cells that lack an arm, repeat one, hold a foreign one, or vary in a column that must be constant."""
    known = F.col(arm).isin(*arms)
    spread = [F.count_distinct(c).alias(f"_{c}") for c in constant]
    found = rows.groupBy(*cell).agg(F.count_distinct(F.when(known, F.col(arm))).alias("_arms"), F.count_if(known).alias("_rows"), F.count_if(~known | F.col(arm).isNull()).alias("_foreign"), *spread)
    codes = [F.when(F.col("_arms") < len(arms), "arm.missing"), F.when(F.col("_rows") > F.col("_arms"), "arm.repeated"), F.when(F.col("_foreign") > 0, "arm.foreign")]
    codes += [F.when(F.col(f"_{c}") > 1, f"{c}.varies") for c in constant]
    return found.select(*cell, F.explode(F.array_compact(F.array(*codes))).alias("code"))


def denominator_drift(rows: DataFrame, cell: Sequence[str], shape: Column) -> DataFrame:
    """Cells whose arms do not share one denominator shape, with the number of shapes."""
    out = rows.groupBy(*cell).agg(F.count_distinct(F.sha2(F.coalesce(shape.cast("string"), F.lit("")), 256)).alias("shapes"))
    return out.where("shapes > 1")


def coverage_profile(rows: DataFrame, least: int = 30, most: int = 50, teachers: int = 2) -> DataFrame:
    """events, windows with several events, operations and teachers of a dataset (event_id, window_id, operation, teacher), and whether it may be used."""
    windows = rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_edit_windows"))
    whole = rows.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("operation").alias("operations"), F.count_distinct("teacher").alias("teachers"))
    ready = F.col("events").between(least, most) & (F.col("teachers") >= teachers)
    return whole.join(windows).withColumn("ready", ready)


def value_gate(metrics: DataFrame, blocked: Column | None = None, gain: float = 0.05, must_gain: Sequence[str] = ("evidence_f1", "temporal_fidelity", "edit_coverage"), must_not_rise: str = "unsupported_claim_rate", by: Sequence[str] = ()) -> DataFrame:
    """BLOCKED, GO or STOP, one decision for each value of ``by``, from rows (metric, difference, low80): BLOCKED if any row is ``blocked``, GO if each metric of ``must_gain`` has a difference of at least
    ``gain`` with its low bound above 0, and ``must_not_rise`` does not rise."""
    good = F.col("metric").isin(*must_gain) & (F.col("difference") >= gain) & (F.col("low80") > 0)
    calm = (F.col("metric") == must_not_rise) & (F.col("difference") <= 0)
    go = (F.count_if(good) == len(must_gain)) & (F.count_if(calm) == 1)
    out = F.when(go, "GO").otherwise("STOP")
    if blocked is not None:
        out = F.when(F.coalesce(F.max(blocked.cast("int")), F.lit(0)) == 1, "BLOCKED").otherwise(out)
    return metrics.groupBy(*by).agg(out.alias("decision"))


def development_gate(f1: Column, base_f1: Column, coverage: Column, base_coverage: Column, unsupported: Column, base_unsupported: Column, positive_cases: Column, positive_pairs: Column, failures: Column, cases: int = 2, pairs: int = 4) -> Column:
    """GO, FIX or PIVOT_STOP of a development comparison."""
    clean = failures == 0
    go = (positive_cases == cases) & (positive_pairs >= pairs) & (coverage > base_coverage) & (unsupported <= base_unsupported) & clean
    return F.when(go, "GO").when((f1 > base_f1) & clean, "FIX").otherwise("PIVOT_STOP")


#: Fixed value: the F1 that a fix must keep.
FIX_FLOOR = 0.9434523809523809


def fix_gate(f1: Column, coverage: Column, fidelity: Column, unsupported: Column, positive_cases: Column, positive_pairs: Column, failures: Column, floor: float = FIX_FLOOR, cases: int = 2, pairs: int = 4) -> Column:
    go = (f1 >= floor) & (coverage == 1) & (fidelity == 1) & (unsupported == 0) & (positive_cases == cases) & (positive_pairs >= pairs) & (failures == 0)
    return F.when(go, "GO").otherwise("FIX_STOP")


def paired_diagnostic(valid: Column, hard_failure: Column, all_zero: Column, overall: Column, known: Column, question: Column, *drops: Column) -> Column:
    """Whether a prompt fix is retained, needs atomic questions, or a redesign; BLOCKED without valid inputs."""
    kept = ~hard_failure & all_zero & (overall >= -0.02) & (known >= -0.05) & (question >= -0.05)
    atomic = ~hard_failure & (question < -0.05) & reduce(lambda a, b: a | b, (d >= 0.25 for d in drops)) & (known >= -0.05)
    return F.when(~valid, "BLOCKED").when(kept, "REGION_FIX_RETAINED").when(atomic, "ATOMIC_QUESTION_CONTRACT_NEEDED").otherwise("REPRESENTATION_REDESIGN")
