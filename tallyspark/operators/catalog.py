"""Catalogues: soft deletes, tombstones, rollups and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(rows: DataFrame, deleted_at: str, updated_at: str) -> DataFrame:
    """Rows that are not deleted, last updated first."""
    return rows.where(F.col(deleted_at).isNull()).orderBy(F.col(updated_at).desc())


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(tombstones.select(*key), list(key), "left_anti")


def project_rollup(projects: DataFrame, videos: DataFrame, skills: DataFrame, key: str) -> DataFrame:
    """Each project with its video and live skill counts, zeros kept."""
    counts = [df.groupBy(key).agg(F.count(F.lit(1)).alias(name)) for df, name in ((videos, "videos"), (skills, "skills"))]
    return reduce(lambda a, b: a.join(b, key, "left"), counts, projects.select(key)).na.fill(0, ["videos", "skills"])


def conversation_summary(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Turns, answers and the last question of each conversation."""
    question = F.when(F.col(role) == "user", F.col(text))
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col(role) == "assistant").alias("answers"), F.max_by(question, F.when(question.isNotNull(), F.col(order))).alias("last_question"))


def run_summary(runs: Sequence[DataFrame], total: str, done: str, failed: str) -> DataFrame:
    """Runs of several record shapes as one table with a status: failed, partial or completed."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
    status = F.when(F.col(failed) >= F.col(total), "failed").when((F.col(failed) > 0) | (F.col(done) < F.col(total)), "partial").otherwise("completed")
    return rows.withColumn("status", status)


def distinct_bytes(rows: DataFrame, path: str, size: str, by: Sequence[str] = ()) -> DataFrame:
    """Bytes over distinct paths: what deleting them frees."""
    return rows.groupBy(*by, path).agg(F.max(size).alias("_n")).groupBy(*by).agg(F.sum("_n").alias("bytes"), F.count(F.lit(1)).alias("paths"))


def skill_rollup(skills: DataFrame, key: str, variants: str) -> DataFrame:
    """Distinct render targets in order of appearance and the number of actions of nested variants(targets, actions)."""
    targets = F.array_distinct(F.flatten(F.transform(variants, lambda v: v["targets"])))
    actions = F.aggregate(variants, F.lit(0), lambda n, v: n + F.size(v["actions"]))
    return skills.select(key, targets.alias("render_targets"), actions.alias("n_actions"))


def schedule(cases: DataFrame, seeds: Sequence[int], arms: Sequence[str], case: str, domain: str) -> DataFrame:
    """Every case with every seed and arm, numbered in that order, with an id derived from all three."""
    seed = F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    rows = cases.select(case, seed).select("*", F.posexplode(F.array(*map(F.lit, arms))).alias("arm_no", "arm"))
    id_ = F.concat(F.lit("request-"), F.left(F.sha2(F.concat_ws("|", F.lit(domain), F.col(case).cast("string"), F.col("seed").cast("string"), "arm"), 256), F.lit(24)))
    place = (F.row_number().over(Window.partitionBy(case).orderBy("seed", "arm_no")) - 1).cast("int")
    return rows.select(case, "seed", "arm", id_.alias("request_id"), place.alias("case_ordinal"))


def delivery_status(asked: Column, given: Column) -> Column:
    """Whether an answer came in the modality that was asked for; only then may it count as a primary result."""
    return F.when(given.isNull(), "missing").when(asked == given, "as_requested").otherwise("substituted")


def review_order(rows: DataFrame, tiers: Sequence[Column], *then: Column | str) -> DataFrame:
    """Rows by the first tier whose condition holds (the rest last), then by the given columns."""
    tier = reduce(lambda out, item: out.when(item[1], item[0]), list(enumerate(tiers))[1:], F.when(tiers[0], 0)).otherwise(len(tiers))
    return rows.withColumn("tier", tier).orderBy("tier", *then)


def token_totals(messages: DataFrame, role: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums over assistants' messages."""
    return messages.where(F.col(role) == "assistant").groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))
