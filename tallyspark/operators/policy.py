"""Promotion of policy versions, and plans of skills: rules that give issue rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Promotion:
    """Bounds that a promoted version must keep."""

    gain: float = 0.05
    worst_group: float = -0.02
    no_rise: tuple[str, ...] = ("unsupported_claim_rate_delta", "answer_leakage_rate_delta")
    gates: int = 4
    families: int = 2
    no_errors: tuple[str, ...] = ("critical_physics_errors", "critical_diagram_errors")
    split: str = "selection"


def promotion_faults(p: Column, rules: Promotion = Promotion()) -> Column:
    """Codes that speak against a promotion record (struct), in a fixed order; an empty array lets it pass. A metric that is null fails."""
    gates = F.coalesce(p["gate_results"], F.array().cast("array<struct<gate:string,status:string>>"))
    passed = F.size(F.array_distinct(F.transform(F.filter(gates, lambda g: g["status"] == "pass"), lambda g: g["gate"])))
    failed = F.exists(gates, lambda g: ~g["status"].eqNullSafe(F.lit("pass")))
    families = F.coalesce(p["family_deltas"], F.array().cast("array<struct<family_id:string,episode_success_delta:double>>"))
    positive = F.size(F.array_distinct(F.transform(F.filter(families, lambda f: f["episode_success_delta"] > 0), lambda f: f["family_id"])))
    good = lambda c: F.coalesce(c, F.lit(False))
    metric = good(p["selection_gain"] >= rules.gain) & good(p["worst_group_delta"] >= rules.worst_group)
    for name in rules.no_rise:
        metric = metric & good(p[name] <= 0)
    errors = good(p[rules.no_errors[0]] == 0)
    for name in rules.no_errors[1:]:
        errors = errors & good(p[name] == 0)
    checks = {
        "policy.test_leakage": ~p["split"].eqNullSafe(F.lit(rules.split)),
        "policy.metric_threshold": ~metric,
        "policy.gate_result": failed | (passed < rules.gates),
        "policy.family_gain": positive < rules.families,
        "policy.critical_error": ~errors,
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in checks.items()]))


def promotion_issues(versions: DataFrame, key: str, promotion: str, rules: Promotion = Promotion()) -> DataFrame:
    """(key, code) for each version that says it is promoted and should not be."""
    rows = versions.where(F.col(f"{promotion}.decision") == "promote")
    return rows.select(key, F.explode(promotion_faults(F.col(promotion), rules)).alias("code"))


def unwritable_references(experiences: DataFrame, uses: DataFrame, key: str, mode: str = "write_mode") -> DataFrame:
    """Uses of experiences that must not be written from, or that are not there: (columns of ``uses``, code)."""
    found = uses.join(experiences.select(key, mode), key, "left")
    code = F.when(F.col(mode).isNull(), "policy.experience_ref").when(F.col(mode) == "NO_WRITE", "policy.no_write_ref")
    return found.withColumn("code", code).where("code is not null").select(*uses.columns, "code")


def plan_issues(actions: DataFrame, plans: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, action_id, code): render_plan.coverage for actions that are not in exactly one plan, render_plan.action_ref for planned actions that are not there."""
    used = plans.select(*key, F.explode("action_ids").alias("action_id")).groupBy(*key, "action_id").agg(F.count(F.lit(1)).alias("times"))
    held = actions.select(*key, "action_id").distinct().withColumn("held", F.lit(True))
    both = held.join(used, [*key, "action_id"], "full")
    code = F.when(F.col("held").isNull(), "render_plan.action_ref").when(F.coalesce("times", F.lit(0)) != 1, "render_plan.coverage")
    return both.withColumn("code", code).where("code is not null").select(*key, "action_id", "code")


def step_issues(actions: DataFrame, key: Sequence[str], position: str, step: str) -> DataFrame:
    """(key, position, code): action.step_order where a step is not above the one before it."""
    before = F.lag(step).over(Window.partitionBy(*key).orderBy(position))
    rows = actions.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(step).isNull() | (F.col(step) <= F.col("before"))))
    return rows.select(*key, position, F.lit("action.step_order").alias("code"))


def signoff_issues(signoffs: DataFrame, package: str, roles: Sequence[str]) -> DataFrame:
    """(package, code): signoff.missing without one of ``roles``, signoff.same_person where two roles share a signer, signoff.commitment where they sign different decisions."""
    rows = signoffs.where(F.col("signoff_role").isin(*roles))
    by = rows.groupBy(package).agg(
        F.count_distinct("signoff_role").alias("roles"), F.count_distinct("adjudicator_id").alias("people"), F.count_distinct(F.array_join(F.array_sort("decision_signatures"), ",")).alias("sets")
    )
    every = signoffs.select(package).distinct().join(by, package, "left")
    codes = F.array_compact(
        F.array(
            F.when(F.coalesce("roles", F.lit(0)) < len(roles), "signoff.missing"),
            F.when(F.col("people") < F.col("roles"), "signoff.same_person"),
            F.when(F.col("sets") > 1, "signoff.commitment"),
        )
    )
    return every.select(package, F.explode(codes).alias("code"))


def component_windows(groups: DataFrame, package: str, start: str, end: str, most: float) -> DataFrame:
    """(package, start, end, groups): stretches of a package's windows that touch within ``most`` seconds of each other."""
    w = Window.partitionBy(package).orderBy(start, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(so_far.isNull() | (F.col(start) > so_far + most), 1).otherwise(0)
    rows = groups.withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(package, "stretch").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("groups")).drop("stretch")
