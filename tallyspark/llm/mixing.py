"""Mixing sources to target weights, in DataFrame functions only.

The words of each source are packed, document after document, into blocks of equal lengths. Output shards
draw multinomial source counts; a source's slots go through pseudorandom permutations of its block
indices, one a pass (Feistel networks that walk on from places outside); blocks and slots meet by index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, materialise, with_before

#: A source has so many blocks at least, or one a word; its target is met to half a block.
LEAST_BLOCKS = 16


@dataclass(frozen=True)
class Plan:
    """sources: key, source, source_size, target, n_blocks, n_slots, low, longer (the first ``longer`` blocks have low + 1 words, the others low); rows: doc_id, key, part, rn, size, start; slots: shard, slot, key, pass, block."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that equals itself also for the null source, and sorts as sources do, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of the sources of (key, source, size): shares of ``share`` of all words by weight, none above
    ``cap`` times its source; what is above is shared again by weight.

    Ordered by cap over weight, sources stop at their cap until the level that the rest can share lies below
    the next one's; that level times its weight is a further source's target. One row a source."""
    total = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    at = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int"))
    by = Window.orderBy("ratio", "key")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = total.withColumn("weight", at.cast("double")).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    total = total.withColumn("level", level).withColumn("place", F.row_number().over(by))
    total = total.withColumn("shared", F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("place"))).over(whole))
    return total.select("key", "source", "source_size", F.least("most", F.coalesce(F.col("shared") * F.col("weight"), F.col("most"))).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_slots: int = 4096, seed: int = 17) -> Plan:
    """Plans a mix of ``docs`` (doc_id, text, source).

    Sources by code point, null last, take ``weights`` in turn. Every block is taken at most ceil(cap) times.
    A null text has no words; a source without words gets target 0; an empty table gives empty tables.
    Repeated rows are rows of their own, next to each other in their source. The plan depends on the rows
    and ``seed`` alone, not on their order or partitions.

    Sizes, rows and slots are written once to the shared checkpoint folder: what uses the plan reads three tables, where one query of all its
    steps took the driver hundreds of MB. The texts are not moved. Words before a row
    are counted in two steps (parts of a source, then rows of a part), and slots in shards, so no task
    holds a source. A source's blocks have at most ``block_words`` words, and equal lengths to one word. Draws that a
    source has above its slots go to the sources that have too few, so each gets the round number of its blocks
    that its target asks for; both sides of that are about the square root of the slots."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", source_key(F.col("source")))
    sized = materialise(sized, "mix-sizes")
    parts = max(1, sized.count() // 20_000)
    sources = targets(sized, weights, share, cap)
    n_blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.least("source_size", F.lit(LEAST_BLOCKS).cast("long")))
    n_slots = F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = sources.withColumn("n_blocks", n_blocks).withColumn("n_slots", n_slots)
    sources = sources.withColumns({"low": F.expr("source_size div greatest(n_blocks, 1)"), "longer": F.expr("source_size % greatest(n_blocks, 1)")})
    sources = materialise(sources, "mix-sources")

    rows = sized.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    order = Window.partitionBy("key", "part").orderBy("doc_id", "size")
    inner = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = with_before(rows.groupBy("key", "part").agg(F.sum("size").alias("n")), ["key"], "part", "n").select("key", "part", F.col("before").alias("base"))
    base = materialise(base, "mix-parts")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("inner", inner).join(base, ["key", "part"])
    rows = rows.select("doc_id", "key", "part", "rn", "size", (F.col("base") + F.col("inner")).alias("start"))
    return Plan(sources, materialise(rows, "mix-rows"), materialise(draw(sources, shard_slots, seed), "mix-slots"))


def draw(sources: DataFrame, shard_slots: int, seed: int, cells: int = 4096) -> DataFrame:
    """(shard, slot, key, pass, block) for each slot of the mix; ``sources`` is (key, n_slots, n_blocks)."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    width = max(n, 1)
    upto = F.sum("n_slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ranges = sources.where("n_slots > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n_slots"))
    cell = lambda u: F.expr(f"({u} * {cells}L) div {width}L")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("(hi - 1)"))))
    # A slot's uniform draw falls in one source's range: its shard's counts are multinomial.
    drawn = spark.range(n).select(F.expr(f"id div {shard_slots}").alias("shard"), (F.col("id") % shard_slots).alias("slot"))
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(width))).withColumn("cell", cell("u"))
    drawn = drawn.join(ranges, "cell").where("u >= lo and u < hi").select("shard", "slot", "key", "n_slots")
    counts = materialise(with_before(drawn.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")), ["key"], "shard", "n"), "mix-counts")
    within = F.row_number().over(Window.partitionBy("key", "shard").orderBy("slot")) - 1
    ranked = drawn.withColumn("within", within).join(counts.select("key", "shard", "before"), ["key", "shard"])
    ranked = materialise(ranked.select("shard", "slot", "key", "n_slots", (F.col("before") + F.col("within")).alias("k")), "mix-ranked")

    freed = ranked.where("k >= n_slots").select("shard", "slot")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1
    earlier = with_before(freed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), [], "shard", "n").select("shard", "before")
    freed = freed.withColumn("place", place).join(earlier, "shard").select("shard", "slot", (F.col("before") + F.col("place")).alias("i"))
    got = counts.groupBy("key").agg(F.sum("n").alias("got"))
    short = sources.join(got, "key", "left").select("key", "n_slots", F.coalesce("got", F.lit(0)).alias("got")).where("got < n_slots")
    first = F.coalesce(F.sum(F.col("n_slots") - F.col("got")).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = short.withColumn("first", first).withColumn("k", F.explode(F.sequence("got", F.col("n_slots") - 1)))
    refilled = short.select("key", "k", (F.col("first") + F.col("k") - F.col("got")).alias("i")).join(freed, "i")
    every = ranked.where("k < n_slots").select("shard", "slot", "key", "k").unionByName(refilled.select("shard", "slot", "key", "k"))

    every = every.join(sources.select("key", "n_blocks"), "key").withColumn("pass", F.expr("k div n_blocks"))
    every = permuted(every.withColumn("x", F.expr("k % n_blocks")).withColumn("noise", F.xxhash64(F.lit(seed + 1), "key", "pass")), "x", "n_blocks", "noise", "block")
    return every.select("shard", "slot", "key", "pass", "block")


def moved(own: Column, by: Column, size: Column, noise: Column, i: Column) -> Column:
    return F.pmod(own + F.pmod(F.xxhash64(noise, i, by), size), size)


def permuted(rows: DataFrame, x: str, n: str, noise: str, out: str, halves: int = 8) -> DataFrame:
    """``rows`` with ``out``: the place of x in a pseudorandom permutation of the numbers below n, another one for each ``noise``.

    A Feistel network permutes the least rectangle of ceil(sqrt(n)) rows that holds n places: in turn row and column are moved around by
    a hash of the other, which can be undone. A place out of range goes through the network again till it is back in, at most as often as there are such places."""
    a = F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long")
    rows = rows.withColumn("_a", a).withColumn("_b", F.expr(f"(`{n}` + _a - 1) div _a"))
    rows = rows.withColumns({"_l": F.expr(f"`{x}` div _b"), "_r": F.col(x) % F.col("_b")})
    size, noise_of = {"_l": F.col("_a"), "_r": F.col("_b")}, F.col(noise)
    for i in range(halves):
        own, by = ("_l", "_r") if i % 2 == 0 else ("_r", "_l")
        rows = rows.withColumn(own, moved(F.col(own), F.col(by), size[own], noise_of, F.lit(i)))
    rows = rows.withColumn("_at", F.col("_l") * F.col("_b") + F.col("_r"))

    def half(at: Column, i: Column) -> Column:
        left = F.struct(moved(at["l"], at["r"], F.col("_a"), noise_of, i).alias("l"), at["r"].alias("r"))
        right = F.struct(at["l"].alias("l"), moved(at["r"], at["l"], F.col("_b"), noise_of, i).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    def again(at: Column) -> Column:
        start = F.struct(F.floor(at / F.col("_b")).cast("long").alias("l"), (at % F.col("_b")).alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(halves))), start, half, lambda x: x["l"] * F.col("_b") + x["r"])

    outside = F.sequence(F.lit(1).cast("long"), F.col("_a") * F.col("_b") - F.col(n))
    on = F.aggregate(outside, F.col("_at"), lambda at, _: F.when(at < F.col(n), at).otherwise(again(at)))
    return rows.withColumn(out, F.when(F.col("_at") < F.col(n), F.col("_at")).otherwise(on)).drop("_a", "_b", "_l", "_r", "_at")


def segments(plan: Plan) -> DataFrame:
    """Each row's stretches by block: key, part, rn, doc_id, size, block, lo, hi (words of the row, hi exclusive); one without block where size is 0."""
    block_of = lambda w: F.expr(f"if({w} < longer * (low + 1), {w} div (low + 1), longer + ({w} - longer * (low + 1)) div low)")
    first = lambda block: block * F.col("low") + F.least(block, F.col("longer"))
    blocks = F.when(F.col("size") > 0, F.sequence(block_of("start"), block_of("(start + size - 1)")))
    out = plan.rows.join(plan.sources.select("key", "low", "longer"), "key").withColumn("block", F.explode_outer(blocks))
    lo = F.greatest(first(F.col("block")) - F.col("start"), F.lit(0))
    hi = F.least(first(F.col("block") + 1) - F.col("start"), F.col("size"))
    return out.select("key", "part", "rn", "doc_id", "size", "block", lo.alias("lo"), hi.alias("hi"))


def taken_words(plan: Plan) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each planned row; taken: its words in the mix, repeats counted."""
    uses = plan.slots.groupBy("key", "block").agg(F.count(F.lit(1)).alias("uses"))
    words = F.sum((F.col("hi") - F.col("lo")) * F.coalesce("uses", F.lit(0)))
    taken = segments(plan).join(uses, ["key", "block"], "left").groupBy("key", "part", "rn", "doc_id", "size").agg(F.coalesce(words, F.lit(0)).alias("taken"))
    return taken.join(plan.sources, "key").select("doc_id", "size", "source_size", "target", "taken")


def row_key(doc_id: str = "doc_id") -> Column:
    """The id as text; a null id has a key as well."""
    return F.coalesce(F.concat(F.lit("0"), F.col(doc_id).cast("string")), F.lit("1"))


def mixed_documents(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs``, all columns, as the mix takes them: a row for each pass that takes words of it, with the text of those words.

    A text taken whole stays as it is; else the words' stretches follow each other with the blanks after
    them. n_chars, where there is one, is counted anew. Rows without words, or whose blocks no pass takes, go.
    Texts are shuffled once, by id; repeated rows (equal id, source and size) take their own cuts in turn."""
    names = ["_id", "_key", "_size"]
    if clash := {*names, "_dup", "_cuts", "_n", "_words"} & set(docs.columns):
        raise ValueError(f"documents with columns {sorted(clash)}: rename them")
    rows = plan.rows.select(row_key().alias("_id"), F.col("key").alias("_key"), F.col("size").alias("_size"), "part", "rn")
    rows = rows.withColumn("_dup", F.row_number().over(Window.partitionBy(*names).orderBy("part", "rn")))
    cuts = segments(plan).where("block is not null").join(plan.slots.select("key", "block", "pass"), ["key", "block"])
    cuts = cuts.groupBy("key", "part", "rn", "pass").agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi"))).alias("_cuts"), F.sum(F.col("hi") - F.col("lo")).alias("_n"))
    cuts = cuts.withColumnRenamed("key", "_key").join(rows, ["_key", "part", "rn"]).select(*names, "_dup", "_cuts", "_n")
    own = docs.withColumns({"_id": row_key(), "_key": source_key(F.col("source")), "_size": word_count(F.col("text"))})
    again = rows.where("_dup > 1").select(*names).distinct()
    if again.limit(1).count():
        in_turn = F.row_number().over(Window.partitionBy(*names).orderBy("text"))
        own = own.join(again, names, "left_anti").withColumn("_dup", F.lit(1)).unionByName(own.join(again, names, "left_semi").withColumn("_dup", in_turn))
    else:
        own = own.withColumn("_dup", F.lit(1))
    out = own.join(cuts, [*names, "_dup"])
    part = F.col("_n") < F.col("_size")
    out = out.withColumn("_words", F.when(part, F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))))
    pieces = F.transform("_cuts", lambda c: F.array_join(F.slice("_words", (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")), ""))
    out = out.withColumn("text", F.when(part, F.array_join(pieces, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
