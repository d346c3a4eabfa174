"""Greedy packing and budgets over ordered items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.tables import materialise


def chunk_lines(text: Column, limit: int) -> Column:
    """array of chunks: lines in order, a new chunk where the next line and its break would pass ``limit`` characters.

    A line longer than the limit is a chunk of its own; chunks of blanks at the end go; without any chunk
    the text's first ``limit`` characters are one. State resets at each chunk, so this folds over a document's lines."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, line: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(line) + 1 > limit) & (F.length(acc["now"]) > 0)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.concat(F.when(full, "").otherwise(acc["now"]), line, F.lit("\n")).alias("now"))

    def end(acc: Column) -> Column:
        done = F.when(F.trim(F.regexp_replace(acc["now"], r"\s+", " ")) != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.when(F.size(done) > 0, done).otherwise(F.array(F.left(text, F.lit(limit))))

    return F.aggregate(F.split(text, "\n"), start, step, end)


#: Rows of a key that one task takes where batches are made in parts.
PART = 65_536


def batch_rows(rows: DataFrame, key: str, order: Sequence[str], size: str, most_items: int, most_bytes: int, part: int = PART) -> DataFrame:
    """``rows`` with batch (from 0 in each key): in order, a new batch at ``most_items`` items or where bytes would pass ``most_bytes``.

    An item larger than ``most_bytes`` fits nowhere: its key gets no rows. Where no key has more than ``part`` rows each key is walked by one
    task. Else a key's rows are numbered and summed in two steps over range partitions, and cut into parts of ``part`` rows, with the rows
    behind a part that a batch may still take. Where a batch begins decides where the next one does, so each part tells for its first
    ``most_items`` rows (a batch that comes from before begins the next one there) where the first batch after the part begins. These
    few pointers are followed from each key's first row in rounds that double the way; then each part numbers its own rows."""
    fits = rows.join(rows.where(F.col(size) > most_bytes).select(key).distinct(), key, "left_anti").select(*rows.columns)
    part = max(part, most_items)
    top = fits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if top <= part:
        return walked_batches(fits, key, order, size, most_items, most_bytes)
    sizes = ordered_sums(fits, key, order, size)
    return parted_batches(sizes.withColumn("_part", F.expr(f"_pos div {part}")), key, most_items, most_bytes, part, rows.columns)


def ordered_sums(rows: DataFrame, key: str, order: Sequence[str], size: str) -> DataFrame:
    """``rows`` with _pos (from 0) and _before (the sum of ``size`` before it) in each key's order; no task holds a whole key."""
    ids = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id())
    ids = materialise(ids, "batch-rows").withColumns({"_task": F.shiftright("_id", 33), "_n": F.lit(1).cast("long"), "_size": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    ahead = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    bases = ids.groupBy(F.col(key).alias("_key"), F.col("_task").alias("_of")).agg(F.sum("_n").alias("_n"), F.sum("_size").alias("_size"))
    along = ahead(["_key"], "_of")
    bases = bases.select("_key", "_of", upto("_n", along).alias("_base_n"), upto("_size", along).alias("_base_size"))
    within = ahead([key, "_task"], "_id")
    own = ids.withColumns({"_pos": upto("_n", within), "_before": upto("_size", within)})
    both = own.join(bases, (F.col("_task") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    out = both.select(*rows.columns, "_size", (F.col("_base_n") + F.col("_pos")).alias("_pos"), (F.col("_base_size") + F.col("_before")).alias("_before"))
    return materialise(out, "batch-sums")


def steps_of(pos: np.ndarray, before: np.ndarray, sizes: np.ndarray, most_items: int, most_bytes: int) -> np.ndarray:
    """For each row the place, in these rows, where the batch after one that begins at it would begin."""
    after = before + sizes
    return np.minimum(np.searchsorted(after, before + most_bytes, "right"), np.arange(len(pos)) + most_items)


def parted_batches(sizes: DataFrame, key: str, most_items: int, most_bytes: int, part: int, columns: list[str]) -> DataFrame:
    near = sizes.select(key, "_part", "_pos", "_before", "_size")
    halo = near.where((F.col("_part") > 0) & (F.col("_pos") % part < most_items)).withColumn("_part", F.col("_part") - 1)
    grouped = near.unionByName(halo)
    kind = sizes.schema[key].dataType.simpleString()

    def leaps(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        pos, before, own = (rows[c].to_numpy() for c in ("_pos", "_before", "_size"))
        end = int(np.searchsorted(pos, (rows["_part"][0].as_py() + 1) * part))
        step = steps_of(pos, before, own, most_items, most_bytes).tolist()
        out, hops = list(range(end)), [1] * end
        for i in range(end - 1, -1, -1):
            if step[i] < end:
                out[i], hops[i] = out[step[i]], 1 + hops[step[i]]
            else:
                out[i] = step[i]
        n = min(most_items, end)
        return pa.table({key: rows[key].slice(0, n), "at": pa.array(pos[:n], pa.int64()), "to": pa.array(pos[0] + np.array(out[:n], np.int64), pa.int64()), "hops": pa.array(hops[:n], pa.int64())})

    jumps = materialise(grouped.groupBy(key, "_part").applyInArrow(leaps, f"`{key}` {kind}, at long, to long, hops long"), "batch-jumps")
    begun = materialise(jumps.where("at = 0").select(F.col(key).alias("_key"), F.col("at").alias("begin"), F.lit(0).cast("long").alias("base")), "batch-begun")
    rounds = int(sizes.agg(F.max("_part")).first()[0] or 0).bit_length()
    for i in range(rounds):
        further = begun.join(jumps, (F.col("begin") == F.col("at")) & F.col(key).eqNullSafe(F.col("_key"))).select("_key", F.col("to").alias("begin"), (F.col("base") + F.col("hops")).alias("base"))
        begun = materialise(begun.unionByName(further).distinct(), "batch-begun")
        if i + 1 < rounds:
            next_ = jumps.select(F.col(key).alias("_k"), F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
            jumps = materialise(jumps.join(next_, (F.col("to") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_k"))).select(key, "at", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops")), "batch-jumps")

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        pos, before, own = (rows[c].to_numpy() for c in ("_pos", "_before", "_size"))
        step = steps_of(pos, before, own, most_items, most_bytes).tolist()
        begin, base = rows["begin"][0].as_py(), rows["base"][0].as_py()
        batch = np.full(len(pos), base - 1, np.int64)  # what comes before the part's first beginning belongs to the batch before it
        i = int(begin - pos[0])
        while i < len(pos):
            batch[i : step[i]] = base
            i, base = step[i], base + 1
        return pa.table({c: rows[c] for c in columns} | {"batch": pa.array(batch, pa.int32())})

    first = begun.groupBy("_key", F.expr(f"begin div {part}").alias("_of")).agg(F.min("begin").alias("begin"), F.min("base").alias("base"))
    whole = sizes.join(first, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    kinds = ", ".join(f"`{c}` {sizes.schema[c].dataType.simpleString()}" for c in columns)
    return whole.select(*sizes.columns, "begin", "base").groupBy(key, "_part").applyInArrow(number, f"{kinds}, batch int")


def walked_batches(rows: DataFrame, key: str, order: Sequence[str], size: str, most_items: int, most_bytes: int) -> DataFrame:
    """``batch_rows`` of rows that all fit, each key walked in order by one task, which keeps three numbers and no rows."""
    fits = rows
    at, by = rows.columns.index(key), rows.columns.index(size)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, items, held = object(), 0, 0, 0
        for part in batches:
            out = []
            for k, n in zip(part.column(at).to_pylist(), part.column(by).to_pylist(), strict=True):
                if k != now:
                    now, batch, items, held = k, 0, 0, 0
                if items and (items >= most_items or held + n > most_bytes):
                    batch, items, held = batch + 1, 0, 0
                items, held = items + 1, held + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], [*part.schema.names, "batch"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fits.schema)
    return fits.repartition(key).sortWithinPartitions(key, *order).mapInArrow(walk, f"{kinds}, batch int")


def last_n(rows: DataFrame, key: Sequence[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def history_budget(turns: DataFrame, key: str, order: str, question: str, answer: str, budget: int = 20_000, digest_budget: int = 4_000, always: int = 2) -> DataFrame:
    """``turns`` with ``part``: recent, digest or omitted.

    Texts are cut first (3,000 and 6,000 characters; turns without either go); newest first, turns are recent while
    their sizes fit the budget, the last ``always`` in any case; of the older ones, lines of at most 180 and 360 characters
    make a digest while they fit its budget, one in any case. Sizes are positive, so running sums decide both."""
    q, a = F.left(F.trim(question), F.lit(3_000)), F.left(F.trim(answer), F.lit(6_000))
    rows = turns.withColumns({"_q": q, "_a": a}).where("_q <> '' and _a <> ''")
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    rows = rows.withColumns({"_n": F.row_number().over(newest), "_sum": F.sum(F.length("_q") + F.length("_a") + 64).over(newest)})
    rows = rows.withColumn("_recent", (F.col("_n") <= always) | (F.col("_sum") <= budget))
    # A turn that does not fit ends the recent ones, whatever follows.
    rows = rows.withColumn("_recent", F.min(F.col("_recent").cast("int")).over(newest) == 1)
    line = F.least(F.length("_q"), F.lit(180)) + F.least(F.length("_a"), F.lit(360)) + F.length(F.lit("- 问：\n  答："))
    older = Window.partitionBy(key, "_recent").orderBy(F.col(order).desc())
    rows = rows.withColumns({"_o": F.row_number().over(older), "_d": F.sum(line).over(older)})
    rows = rows.withColumn("_fits", (F.col("_o") == 1) | (F.col("_d") <= digest_budget))
    part = F.when(F.col("_recent"), "recent").when(F.min(F.col("_fits").cast("int")).over(older) == 1, "digest").otherwise("omitted")
    return rows.withColumn("part", part).drop("_q", "_a", "_n", "_sum", "_recent", "_o", "_d", "_fits")
