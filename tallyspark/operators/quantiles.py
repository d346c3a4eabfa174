"""Exact percentiles without a task that holds all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a key's values.
BUCKETS = 256


def percentiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(by, p, value): linear interpolation between order statistics for each p of ``at``; nulls are left out, and keys without a value.

    Equal values are counted first. A sketch of them deals each key's values to buckets of about equal size, bucket sums give the
    ranks before a bucket, and only the values at the wanted ranks are kept. The sketch decides where values are counted, not the result."""
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    counts = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = counts.groupBy(*names).agg(F.percentile_approx("_v", cuts, 10_000).alias("_cuts"), F.sum("_n").alias("_total"))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    dealt = counts.alias("a").join(bounds.alias("b"), same).select(*(f"a.{n}" for n in names), "_v", "_n", "_total", below.alias("_b"))
    sums = dealt.groupBy(*names, "_b").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy(*names, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"c.{n}")) for n in [*names, "_b"]]
    ranked = dealt.alias("a").join(sums.alias("c"), same).select(*(F.col(f"a.{n}").alias(n) for n in names), "_v", "_n", "_total", (F.col("_base") + F.col("_in")).alias("_lo"))
    # Rank p * (n - 1) lies between two whole ranks; the value that covers a rank is kept.
    wanted = ranked.withColumn("p", F.explode(F.array(*map(F.lit, map(float, at))))).withColumn("_at", F.col("p") * (F.col("_total") - 1))
    covers = lambda r: (r >= F.col("_lo")) & (r < F.col("_lo") + F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")
    kept = wanted.where(covers(low) | covers(high))
    low, high = (F.max(F.when(covers(r), F.col("_v").cast("double"))) for r in (low, high))
    out = kept.groupBy(*names, "p", "_at").agg(low.alias("_low"), high.alias("_high"))
    part = F.col("_at") - F.floor("_at")
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(by)), "p", (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(value))
