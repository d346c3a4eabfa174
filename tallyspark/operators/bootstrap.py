"""Paired hierarchical bootstrap of nested clusters, all arms resampled together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.quantiles import percentiles

MASK = 0xFFFFFFFF
#: Most distinct cells of a design; the driver holds them and every task gets them.
MAX_CELLS = 10_000


def draws(seed: int, skip: int = 0) -> Iterator[float]:
    """The 32-bit generator's numbers in [0, 1), in order, after the first ``skip``: its state is a multiple."""
    state = (seed + skip * 0x6D2B79F5) & MASK
    while True:
        state = (state + 0x6D2B79F5) & MASK
        t = ((state ^ (state >> 15)) * (state | 1)) & MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
        yield (t ^ (t >> 14)) / 4294967296


def resample(tree: dict | int, numbers: Iterator[float], slot: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int]]:
    """(slot, cell) of one replicate: as many draws with replacement at each cluster as it has children, depth first."""
    if isinstance(tree, int):
        yield slot, tree
        return
    names = sorted(tree)
    for i in range(len(names)):
        yield from resample(tree[names[math.floor(next(numbers) * len(names))]], numbers, (*slot, i))


def fixed_draws(tree: dict | int) -> int | None:
    """How many numbers any replicate takes; None if that depends on what is drawn."""
    if isinstance(tree, int):
        return 0
    below = {fixed_draws(x) for x in tree.values()}
    return None if len(below) != 1 or None in below else len(tree) * (1 + below.pop())


def starts(tree: dict, seed: int, replicates: int) -> Iterator[int]:
    """Numbers taken before each replicate; one pass in order that keeps nothing."""
    taken = 0

    def counted() -> Iterator[float]:
        nonlocal taken
        for x in draws(seed):
            taken += 1
            yield x

    numbers = counted()
    for _ in range(replicates):
        yield taken
        for _ in resample(tree, numbers):
            pass


def resample_plan(design: DataFrame, levels: Sequence[str], seed: int, replicates: int) -> DataFrame:
    """(replicate, slot, last, *levels): for each replicate, the cells it draws, level by level with replacement.

    ``design`` holds the distinct cells of a rated experiment (by contract some dozens; above ``MAX_CELLS`` an error).
    The rows are made by the executors, a replicate at a time, each from its place in the sequence of numbers. Where
    clusters of a level differ in size, that place depends on the draws before, and the driver first counts them,
    a number a replicate. ``slot`` names the drawn place at every level but the last, and keeps repeats of a
    cluster apart; ``last`` is the place at the last."""
    spark = design.sparkSession
    cells = design.select(*levels).distinct().limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"the design has over {MAX_CELLS} distinct cells")
    tree: dict = {}
    for n, row in enumerate(cells):
        at = tree
        for c in levels[:-1]:
            at = at.setdefault(row[c], {})
        at[row[levels[-1]]] = n
    if (each := fixed_draws(tree)) is not None:
        begun = spark.range(replicates).select(F.col("id").alias("replicate"), (F.col("id") * each).alias("skip"))
    else:
        begun = spark.createDataFrame(list(enumerate(starts(tree, seed, replicates))), "replicate long, skip long").repartition(spark.sparkContext.defaultParallelism)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for replicate, skip in zip(batch["replicate"].to_pylist(), batch["skip"].to_pylist(), strict=True):
                out = [(".".join(map(str, slot[:-1])), slot[-1], cell) for slot, cell in resample(tree, draws(seed, skip))]
                slots, last, cell = zip(*out, strict=True) if out else ((), (), ())
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([replicate] * len(out), slots, last, cell), kinds, strict=True)], ["replicate", "slot", "last", "cell"])

    plan = begun.mapInArrow(drawn, "replicate int, slot string, last int, cell int")
    kinds = ", ".join(f"`{c}` {design.schema[c].dataType.simpleString()}" for c in levels)
    named = spark.createDataFrame([(n, *row) for n, row in enumerate(cells)], f"cell int, {kinds}")
    return plan.join(F.broadcast(named), "cell").select("replicate", "slot", "last", *levels)


def bootstrap_difference(rows: DataFrame, levels: Sequence[str], arm: str, left: str, right: str, values: Sequence[str], seed: int, replicates: int) -> DataFrame:
    """(replicate, *values): macro mean of ``left`` less that of ``right`` over each replicate's resample.

    One plan serves all values. Slots stand for clusters, so a cluster drawn twice weighs twice at its level."""
    plan = resample_plan(rows, levels, seed, replicates)
    cells = rows.where(F.col(arm).isin(left, right)).groupBy(*levels, arm).agg(*(F.avg(v).alias(v) for v in values))
    drawn = F.broadcast(cells).join(plan, list(levels))
    parts = F.split("slot", r"\.")
    names = [f"_s{i}" for i in range(len(levels) - 1)]
    drawn = drawn.select("replicate", arm, "last", *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)), *values)
    keys = [*names, "last"]
    for depth in range(len(keys) - 1, -1, -1):
        drawn = drawn.groupBy("replicate", arm, *keys[:depth]).agg(*(F.avg(v).alias(v) for v in values))
    pick = lambda v, a: F.max(F.when(F.col(arm) == a, F.col(v)))
    return drawn.groupBy("replicate").agg(*((pick(v, left) - pick(v, right)).alias(v) for v in values))


def intervals(replicates: DataFrame, values: Sequence[str]) -> DataFrame:
    """(metric, low95, low80, high80, high95) by linear interpolation between order statistics."""
    long = replicates.select(F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values))).alias("m")).select("m.*")
    found = percentiles(long, ["metric"], "x", (0.025, 0.1, 0.9, 0.975))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("x")))
    return found.groupBy("metric").agg(at(0.025).alias("low95"), at(0.1).alias("low80"), at(0.9).alias("high80"), at(0.975).alias("high95"))
