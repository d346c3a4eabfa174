"""Joins and checks on intervals and ordered events. Every join has an equality key, so none becomes a product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap: touching intervals do not meet."""
    return (a_start < b_end) & (b_start < a_end)


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intersection: touching intervals meet."""
    return (a_end >= b_start) & (a_start <= b_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether a contains b, ends included."""
    return (a_start <= b_start) & (b_end <= a_end)


def window_overlap_join(events: DataFrame, spans: DataFrame, key: str, before: Column | float, after: Column | float, low: Column | float = 0, high: Column | None = None, bucket: int | None = None) -> DataFrame:
    """Events (key, start, end) with the spans (key, span_start, span_end) that overlap their window: the event widened by
    ``before`` and ``after`` and clamped to [low, high]; half-open. Columns of both sides.

    ``bucket``: a width that deals both sides by time as well as key, so a key with very many rows is spread; an
    overlapping pair is kept in the first bucket that both reach, hence once."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    start = F.greatest(F.col("start") - lit(before), lit(low))
    end = F.col("end") + lit(after)
    if high is not None:
        end = F.least(end, high)
    wide = events.withColumns({"window_start": start, "window_end": end})
    meet = overlaps(F.col("window_start"), F.col("window_end"), F.col("span_start"), F.col("span_end"))
    if bucket is None:
        return wide.join(spans, key).where(meet)
    cell = lambda x: F.floor(x / bucket).cast("long")
    wide = wide.where("window_start < window_end").withColumn("_b", F.explode(F.sequence(cell(F.col("window_start")), cell(F.col("window_end")))))
    spans = spans.where("span_start < span_end").withColumn("_b", F.explode(F.sequence(cell(F.col("span_start")), cell(F.col("span_end")))))
    first = F.greatest(cell(F.col("window_start")), cell(F.col("span_start")))
    return wide.join(spans, [key, "_b"]).where(meet & (F.col("_b") == first)).drop("_b")


def containment_issues(inner: DataFrame, outer: DataFrame, fk: str, pk: str, code: str) -> DataFrame:
    """(fk, code) of inner rows (fk, start, end) that leave their outer row (pk, outer_start, outer_end); a dangling key is another rule's."""
    both = inner.join(outer, inner[fk] == outer[pk])
    return both.where(~contains(F.col("outer_start"), F.col("outer_end"), F.col("start"), F.col("end"))).select(fk, "start", "end", F.lit(code).alias("code"))


def around(points: DataFrame, targets: DataFrame, key: str, at: str, target_at: str, target_id: str, bucket: int) -> DataFrame:
    """``points`` as struct ``_p`` with their time ``_t``, ``_last`` (t, n: minus its id) and ``_first`` (t, n: its id): the last target
    of the key up to that time and the first from it on; of those at one time, the smallest id.

    Both are merged in time order, one sort a direction, no pairs. Rows are dealt by key and stretches of ``bucket`` time; what lies
    beyond a stretch comes from the ends of the key's other stretches, of which there is one row each."""
    shape = points.select(F.struct(*points.columns).alias("x")).schema["x"].dataType
    rows = points.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct(*points.columns).alias("_p"), F.lit(None).cast("long").alias("_id")).unionByName(
        targets.select(F.col(key).alias("_k"), F.col(target_at).alias("_t"), F.lit(None).cast(shape).alias("_p"), F.col(target_id).cast("long").alias("_id"))
    )
    rows = rows.withColumn("_b", F.floor(F.col("_t") / bucket).cast("long"))
    late = F.when(F.col("_id").isNotNull(), F.struct(F.col("_t").alias("t"), (-F.col("_id")).alias("n")))
    early = F.when(F.col("_id").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_id").alias("n")))
    whole = Window.unboundedPreceding
    ends = rows.groupBy("_k", "_b").agg(F.max(late).alias("_max"), F.min(early).alias("_min"))
    before = F.max("_max").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(whole, -1))
    behind = F.min("_min").over(Window.partitionBy("_k").orderBy(F.desc("_b")).rowsBetween(whole, -1))
    ends = ends.select(F.col("_k").alias("_ek"), F.col("_b").alias("_eb"), before.alias("_before"), behind.alias("_behind"))
    stretch = Window.partitionBy("_k", "_b")
    last = F.max(late).over(stretch.orderBy("_t").rangeBetween(whole, Window.currentRow))
    first = F.min(early).over(stretch.orderBy(F.desc("_t")).rangeBetween(whole, Window.currentRow))
    rows = rows.withColumns({"_last": last, "_first": first}).where("_p is not null")
    rows = rows.join(ends, rows["_k"].eqNullSafe(ends["_ek"]) & rows["_b"].eqNullSafe(ends["_eb"]), "left")
    return rows.select("_p", "_t", F.coalesce("_last", "_before").alias("_last"), F.coalesce("_first", "_behind").alias("_first"))


def nearest(points: DataFrame, targets: DataFrame, key: str, at: str, target_at: str, target_id: str, bucket: int) -> DataFrame:
    """Each point with nearest_id and gap: the target of its key nearest in time (whole numbers; ties to the earlier, then
    the smaller id); points without one stay. ``bucket``: the time by which a key's rows are dealt."""
    rows = around(points, targets, key, at, target_at, target_id, bucket)
    behind, before = F.col("_t") - F.col("_last.t"), F.col("_first.t") - F.col("_t")
    early = F.col("_last").isNotNull() & (F.col("_first").isNull() | (behind <= before))
    return rows.select("_p.*", F.when(early, -F.col("_last.n")).otherwise(F.col("_first.n")).alias("nearest_id"), F.when(early, behind).otherwise(before).alias("gap"))


def near_semi_join(rows: DataFrame, points: DataFrame, key: str, reach: int, bucket: int) -> DataFrame:
    """Rows (key, start, end) with some point (key, at) within ``reach`` of them, ends included.

    There is one if the first point from start - reach on does not lie behind end + reach."""
    asked = rows.withColumn("_from", F.col("start") - reach)
    found = around(asked, points.withColumn("_id0", F.lit(0)), key, "_from", "at", "_id0", bucket)
    return found.where(F.col("_first.t") <= F.col("_p.end") + reach).select("_p.*").drop("_from")


def order_violations(rows: DataFrame, key: Sequence[str], position: str, value: str, strict: bool = False) -> DataFrame:
    """Rows whose value falls behind (or, if strict, does not pass) the one before them in position order, with that value."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(position))
    rows = rows.withColumn("previous", before)
    return rows.where(F.col(value) <= F.col("previous") if strict else F.col(value) < F.col("previous"))


def ordinal_issues(rows: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """Rows whose ordinal is not their place (from 0) among the rows of their key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(ordinal)) - 1
    return rows.withColumn("expected", place).where(F.col(ordinal) != F.col("expected"))


def adjacent_overlaps(rows: DataFrame, key: Sequence[str], start: str, end: str, id_: str) -> DataFrame:
    """Rows that begin before the row ahead of them (by start, then id) ends."""
    order = Window.partitionBy(*key).orderBy(start, id_)
    rows = rows.withColumns({"previous_id": F.lag(id_).over(order), "previous_end": F.lag(end).over(order)})
    return rows.where(F.col("previous_end") > F.col(start))


def ordered_pairs(rows: DataFrame, key: str, position: str, id_: str) -> DataFrame:
    """(key, before, after) of all rows of a key, earlier position first; keys are short by contract (the units of one item)."""
    a = rows.select(key, F.col(position).alias("_a"), F.col(id_).alias("before"))
    b = rows.select(key, F.col(position).alias("_b"), F.col(id_).alias("after"))
    return a.join(b, key).where("_a < _b").select(key, "before", "after")


def chain_issues(deltas: DataFrame, states: DataFrame) -> DataFrame:
    """(delta_id, code) of deltas (delta_id, before_id, after_id, start, end) whose states (state_id, start, end) are missing or
    out of order: before.end <= start < end <= after.start."""
    side = lambda name: states.select(F.col("state_id").alias(f"{name}_id"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.lit(True).alias(f"has_{name}"))
    rows = deltas.join(side("before"), "before_id", "left").join(side("after"), "after_id", "left")
    ok = (F.col("before_end") <= F.col("start")) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("after_start"))
    codes = F.array_compact(F.array(F.when(F.col("has_before").isNull(), "delta.before_ref"), F.when(F.col("has_after").isNull(), "delta.after_ref"), F.when(F.col("has_before") & F.col("has_after") & ~ok, "delta.temporal_order")))
    return rows.select("delta_id", F.explode(codes).alias("code"))


def sample_times(total: Column, n: int) -> Column:
    """n times evenly inside (0, total), at least 1 and at most total - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.greatest(total * (i + 1) / (n + 1), F.lit(1.0)), total - 1))


def even_subsample(items: Column, k: int) -> Column:
    """k items spread evenly over an array (ends included, halves to the even index), each once; the array itself if it has no more."""
    n = F.size(items)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(k - 1, 1))).cast("int")))
    return F.when(n <= k, items).when(F.lit(k) <= 1, F.slice(items, 1, 1)).otherwise(F.transform(at, lambda i: F.get(items, i)))


def even_rows(rows: DataFrame, key: Sequence[str], order: str, k: int) -> DataFrame:
    """``even_subsample`` of the rows of each key in order, as rows: places are counted, so no key is gathered in an array."""
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1)
    sizes = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    wanted = F.when(F.col("_n") > k, F.when(F.lit(k) <= 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1))).cast("int"))))
    both = placed.join(sizes.withColumn("_wanted", wanted), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return both.where(F.col("_wanted").isNull() | F.array_contains("_wanted", F.col("_i"))).select(*rows.columns)


def keep_spaced(values: Column, gap: float, limit: int, seed: Column | None = None) -> Column:
    """Of an array of (at, reason, priority), in its order, those at least ``gap`` from all kept before; ``limit`` at most.

    The kept array is bounded by ``limit``, so each step looks at that many."""
    start = F.slice(values, 1, 0) if seed is None else seed
    return F.aggregate(values, start, lambda kept, v: F.when((F.size(kept) < limit) & ~F.exists(kept, lambda k: F.abs(k["at"] - v["at"]) < gap), F.concat(kept, F.array(v))).otherwise(kept))


def frame_plan(rows: DataFrame, most: int = 20) -> DataFrame:
    """``rows`` with plan: array of (at, reason) chosen from cues, scenes and even periods.

    rows: duration, cues and scenes (arrays of seconds). Eight cues at most, then eight scenes at least 4 s apart, then up to
    six periods; by that priority and time, none within 3 s of a chosen one or in the last 0.2 s; then by time."""
    item = lambda at, reason, priority: F.struct(F.lit(priority).alias("priority"), at.cast("double").alias("at"), F.lit(reason).alias("reason"))
    d = F.col("duration")
    cues = F.transform(F.slice("cues", 1, 8), lambda x: item(F.greatest(x + 0.5, F.lit(0.0)), "transcript_cue", 0))
    scenes = keep_spaced(F.transform(F.array_sort(F.transform("scenes", lambda x: F.greatest(x, F.lit(0.0)))), lambda x: item(x, "scene_change", 1)), 4.0, 8)
    n = F.least(F.lit(6), F.greatest(F.lit(1), F.floor(d / 60).cast("int") + 1))
    periods = F.when(d > 1, F.transform(F.sequence(F.lit(1), n), lambda i: item(F.round(d / (n + 1) * i, 3), "periodic", 2)))
    every = F.array_sort(F.concat(cues, scenes, F.coalesce(periods, F.slice(cues, 1, 0))))
    every = F.filter(every, lambda v: v["at"] < F.greatest(d - 0.2, F.lit(0.2)))
    rows = rows.withColumn("_all", every)
    chosen = F.transform(keep_spaced(F.col("_all"), 3.0, most), lambda v: F.struct(F.round(v["at"], 3).alias("at"), v["reason"].alias("reason")))
    return rows.withColumn("plan", F.array_sort(chosen)).drop("_all")
