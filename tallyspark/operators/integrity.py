"""Referential and structural checks that return issue rows instead of raising."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_references(rows: DataFrame, fk: str, targets: DataFrame, pk: str) -> DataFrame:
    """Rows whose reference has no target; null references do not count."""
    keys = targets.select(F.col(pk).alias("_pk"))
    return rows.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def missing_array_references(rows: DataFrame, key: str, refs: str, targets: DataFrame, pk: str) -> DataFrame:
    """(key, ref) for each element of an array of references that has no target."""
    return missing_references(rows.select(key, F.explode(refs).alias("ref")), "ref", targets, pk)


def union_targets(**tables: tuple[DataFrame, str]) -> DataFrame:
    """(kind, target_id) of several tables: what a polymorphic reference may point to."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(pk).cast("string").alias("target_id")) for kind, (df, pk) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def missing_polymorphic(rows: DataFrame, kind: str, target: str, targets: DataFrame) -> DataFrame:
    """Rows whose (kind, target) is not among the targets."""
    to = targets.select(F.col("kind").alias("_kind"), F.col("target_id").alias("_target"))
    return rows.join(to, (F.col(kind) == F.col("_kind")) & (F.col(target).cast("string") == F.col("_target")), "left_anti")


def scope_mismatches(rows: DataFrame, fk: str, scope: str, targets: DataFrame, pk: str, target_scope: str) -> DataFrame:
    """Rows whose target lies in another scope, with both scopes."""
    to = targets.select(F.col(pk).alias("_pk"), F.col(target_scope).alias("target_scope"))
    return rows.join(to, F.col(fk) == F.col("_pk")).where(~F.col(scope).eqNullSafe(F.col("target_scope"))).drop("_pk")


def uncovered(required: DataFrame, used: DataFrame, key: str, times: int = 1) -> DataFrame:
    """(key, uses) of required keys that are not used exactly ``times``."""
    n = used.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return required.select(key).distinct().join(n, key, "left").select(key, F.coalesce("uses", F.lit(0)).alias("uses")).where(F.col("uses") != times)


def duplicate_ids(**tables: tuple[DataFrame, str]) -> DataFrame:
    """(id, kinds, n) of ids that occur twice, within a table or across tables."""
    return union_targets(**tables).groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n")).where("n > 1")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``; none means equal multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key: what a "first match" lookup finds."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_unique(existing: DataFrame, added: DataFrame, order: str) -> DataFrame:
    """Both inputs with equal rows (apart from ``order``) once: the existing one, then the first added."""
    body = [c for c in existing.columns if c != order]
    rows = existing.withColumn("_from", F.lit(0)).unionByName(added.withColumn("_from", F.lit(1)))
    return first_of_each(rows.withColumn("_hash", F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)), ["_hash"], ["_from", order]).drop("_from", "_hash")


def exact_keys(json: Column, keys: Sequence[str]) -> Column:
    """Whether a JSON object has exactly these keys; false for null and for anything but an object."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*(F.lit(k) for k in sorted(keys))), F.lit(False))


def subset_issues(rows: DataFrame, key: Sequence[str], inner: str, outer: str) -> DataFrame:
    """(key, extra) of rows whose inner array has elements that the outer one lacks."""
    extra = F.array_except(inner, outer)
    return rows.select(*key, F.array_sort(extra).alias("extra")).where(F.size("extra") > 0)


def subgraph(children: DataFrame, key: str, kept: DataFrame, refs: str) -> DataFrame:
    """Child rows that the arrays ``refs`` of the kept rows reach."""
    return children.join(kept.select(F.explode(refs).alias("_ref")).distinct(), F.col(key) == F.col("_ref"), "left_semi")


OPERATORS = ("eq", "in", "contains", "gte", "lte", "exists")


def condition(field: str, operator: str, value: object) -> Column:
    """A data-driven condition as a Column; a null field satisfies none (but "exists" with false)."""
    c = F.col(field)
    if operator == "eq":
        out = c == F.lit(value)
    elif operator == "in":
        out = c.isin(*value)  # type: ignore[misc]
    elif operator == "contains":
        out = c.contains(F.lit(value))
    elif operator == "gte":
        out = c >= F.lit(value)
    elif operator == "lte":
        out = c <= F.lit(value)
    elif operator == "exists":
        out = c.isNotNull() if value else c.isNull()
    else:
        raise ValueError(f"operator {operator!r} is none of {OPERATORS}")
    return F.coalesce(out, F.lit(False))


def applicable(all_: Sequence[tuple[str, str, object]] = (), any_: Sequence[tuple[str, str, object]] = (), abstain_when: Sequence[tuple[str, str, object]] = ()) -> Column:
    """Every condition of ``all_`` and, where there are any, one of ``any_`` hold, and none of ``abstain_when``."""
    out = reduce(lambda a, b: a & b, (condition(*c) for c in all_), F.lit(True))
    if any_:
        out = out & reduce(lambda a, b: a | b, (condition(*c) for c in any_))
    return reduce(lambda a, b: a & ~b, (condition(*c) for c in abstain_when), out)


def montage_matches(evidence: DataFrame, montage: DataFrame) -> DataFrame:
    """Evidence whose kind, target, address and hash all equal a montage panel's."""
    return evidence.join(montage.select("kind", "target_id", "uri", "sha256").distinct(), ["kind", "target_id", "uri", "sha256"], "left_semi")
