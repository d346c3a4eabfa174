"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions, and each decision has a context tree over the bytes before it. A tree's
node has Krichevsky-Trofimov estimates of its counts; weighting mixes the nodes of all depths along a context.
The corpus's (depth+1)-gram counts determine every node, so the trees are built from them level by level."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log, log10, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_stream, materialise

#: The end of a text: coded as this byte, which no UTF-8 text holds; as many of them are the context before a text.
END = b"\xff"
CHUNK = 1 << 20
#: Bytes of a word that is its own key; longer ones have 128-bit hashes as keys.
LONG_WORD = 64


@dataclass(frozen=True)
class Limits:
    """Bounds of what is broadcast: the most frequent words and grams. The rest is joined."""

    words: int = 1 << 19
    grams: int = 1 << 21


def word_keys(text: bytes) -> list[bytes]:
    """A key of bounded size for each word of a text and its end (the empty word); no word begins with a blank."""
    words = text.lower().split()
    words.append(b"")
    return [w if len(w) <= LONG_WORD else b" " + xxhash.xxh3_128_digest(w) for w in words]


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram (context bytes, then the byte) of each coded byte of each text and its end; where each text begins."""
    pad = END * depth
    joined = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8).astype(np.int64)
    gram = joined[: len(joined) - depth].copy()
    for i in range(1, depth + 1):
        gram = (gram << 8) | joined[i : len(joined) - depth + i]
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size + depth) - (size + depth)
    first = np.cumsum(size) - size
    return gram[np.repeat(start - first, size) + np.arange(int(size.sum()))], first


def chunks(rows):
    """Groups of rows (a text first) of about CHUNK bytes; a longer text is a group of its own."""
    group, size = [], 0
    for row in rows:
        if group and size + len(row[0]) > CHUNK:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[0])
    if group:
        yield group


def tallied(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def count_corpus(docs: DataFrame, depth: int) -> DataFrame:
    """(word, gram, n) over all of ``docs`` (text bytes, train): training counts of words (the end of a text is the empty
    word) with gram null, and of grams with word null; grams of other texts alone have n = 0."""

    def count(batches):
        words: Counter[bytes] = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def told_words():
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])
            words.clear()
            return out

        def told_grams():
            keys, n = tallied(parts)
            parts[:] = []
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], ["word", "gram", "n"])

        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True)
            for group in chunks((t or b"", train) for t, train in rows):
                for train in (True, False):
                    texts = [t for t, is_train in group if is_train == train]
                    if texts:
                        gram = np.sort(grams_of(texts, depth)[0])
                        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
                        parts.append((gram[first], np.diff(np.concatenate((first, [len(gram)]))) * int(train)))
                    if train:
                        for t in texts:
                            words.update(word_keys(t))
                if sum(len(k) for k, _ in parts) > 2_000_000:
                    parts = [tallied(parts)]
                    if len(parts[0][0]) > 1_500_000:
                        yield told_grams()
                if len(words) > 500_000:
                    yield told_words()
        if words:
            yield told_words()
        if parts:
            yield told_grams()

    return map_stream(docs.select("text", "train"), count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def ln_gamma(z: Column) -> Column:
    """Stirling's series at z + 8, brought down by the recurrence."""
    product, up = z, z + 8
    for i in range(1, 8):
        product = product * (z + i)
    return (up - 0.5) * F.log(up) - up + 0.5 * log(2 * pi) + 1 / (12 * up) - 1 / (360 * up * up * up) - F.log(product)


def with_estimate(nodes: DataFrame) -> DataFrame:
    """lpe: log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones; p1: that estimate of a one next."""
    zero, one = F.col("n0").cast("double"), F.col("n1").cast("double")
    lpe = ln_gamma(zero + 0.5) + ln_gamma(one + 0.5) - ln_gamma(zero + one + 1) - log(pi)
    return nodes.withColumn("lpe", lpe).withColumn("p1", (one + 0.5) / (zero + one + 1))


def bits(grams: DataFrame) -> DataFrame:
    """Each gram's eight decisions: k (context and the byte's leading bits after a 1) and bit."""
    j = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = grams.withColumn("j", j).withColumn("x", F.col("gram").bitwiseAND(255))
    node = F.expr("shiftleft(1L, j) | shiftright(x, 8 - j)")
    return rows.withColumn("k", F.shiftleft(F.shiftright("gram", 8), 8).bitwiseOR(node)).withColumn("bit", F.expr("shiftright(x, 7 - j) & 1"))


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, n, value): log10 of the weighted probability of each gram's byte after its context.

    Bottom-up, a node's weighted probability is half its own estimate and half its children's product, and ``own``
    the share of the first; top-down, a context's estimates are mixed by those shares. One group-by and one join a level."""

    def upper(k: str, level: int) -> Column:
        context = F.shiftright(k, 8).bitwiseAND((1 << (8 * level)) - 1)
        return F.shiftleft(context, 8).bitwiseOR(F.col(k).bitwiseAND(255))

    leaf = bits(grams).groupBy("k").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("n0"), F.sum(F.col("n") * F.col("bit")).alias("n1"))
    levels = [materialise(with_estimate(leaf).withColumn("lpw", F.col("lpe")), "ctw")]
    for level in range(depth - 1, -1, -1):
        up = levels[-1].groupBy(upper("k", level).alias("k")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lpw").alias("below"))
        up = with_estimate(up)
        high = F.greatest("lpe", "below")
        lpw = high + F.log((F.exp(F.col("lpe") - high) + F.exp(F.col("below") - high)) / 2)
        own = 1 / (1 + F.exp(F.least(F.col("below") - F.col("lpe"), F.lit(700.0))))
        levels.append(materialise(up.withColumn("lpw", lpw).withColumn("own", own), "ctw"))
    mixed = levels[-1].select("k", (F.col("own") * F.col("p1")).alias("one"), (1 - F.col("own")).alias("rest"))
    for level in range(1, depth + 1):
        node = levels[depth - level]
        own = F.col("own") if level < depth else F.lit(1.0)
        above = mixed.select(F.col("k").alias("up"), F.col("one").alias("above"), F.col("rest").alias("left"))
        mixed = node.withColumn("up", upper("k", level - 1)).join(above, "up").select("k", (F.col("above") + F.col("left") * own * F.col("p1")).alias("one"), (F.col("left") * (1 - own)).alias("rest"))
    p = F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))
    return bits(grams).join(mixed.select("k", "one"), "k").groupBy("gram", "n").agg(F.sum(F.log10(p)).alias("value"))


class GramTable:
    """An open-addressing table of keys from 0 in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.zeros(len(self.keys))
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            put = self.keys[at] == keys[left]
            self.values[at[put]] = values[left[put]]
            left, at = left[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where a key is not held), and the places of keys not held."""
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], 0.0)
        left = np.flatnonzero((held != keys) & (held != -1))
        lost = [np.flatnonzero(held == -1)]
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.values[at[same]]
            lost.append(left[held == -1])
            left, at = left[go := ~same & (held != -1)], at[go]
        return out, np.concatenate(lost)


def most_frequent(rows: DataFrame, limit: int) -> DataFrame:
    """The rows whose n reaches the least quarter power of two that at most ``limit`` rows reach.

    Their number is bounded without sorting: counts by power are a few hundred numbers at any size."""
    power = F.floor(F.log2("n") * 4).cast("int")
    counts = {r["power"]: r["count"] for r in rows.where("n > 0").groupBy(power.alias("power")).count().collect()}
    least, held = max(counts, default=0) + 1, 0
    for p in sorted(counts, reverse=True):
        held += counts[p]
        if held > limit:
            break
        least = p
    return rows.where((F.col("n") > 0) & (power >= least))


def score_rows(docs: DataFrame, hot_words: dict[bytes, float], hot_grams: tuple[np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """(doc_id, rid, n_tokens, known, base, value, coded, words, grams) of each row: sums over the words and grams at hand, and those that are not."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((hot_words, hot_grams))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        known, arrays = sent.value
        table, get, serial = GramTable(*arrays), known.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = [[] for _ in range(8)]
            for group in chunks((t or b"",) for t in batch.column("text").to_pylist()):
                gram, first = grams_of([t for t, in group], depth)
                value, lost = table.find(gram)
                out[4] += np.add.reduceat(value, first).tolist()
                lost = np.sort(lost)
                out[7] += [gram[x].tolist() for x in np.split(lost, np.searchsorted(lost, first[1:]))]
                for text, in group:
                    words = word_keys(text)
                    found = [get(w) for w in words]
                    cold = [w for w, v in zip(words, found, strict=True) if v is None] if None in found else []
                    out[0].append(serial)
                    serial += 1
                    out[1].append(len(words))
                    out[2].append(len(words) - len(cold))
                    out[3].append(sum(filter(None, found)))
                    out[5].append(len(text) + 1)
                    out[6].append(cold)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "rid", "n_tokens", "known", "base", "value", "coded", "words", "grams"])

    return map_stream(docs.select("doc_id", "text"), score, f"doc_id {kind}, rid long, n_tokens long, known long, base double, value double, coded long, words array<binary>, grams array<long>")


def score_texts(docs: DataFrame, train: Column, depth: int = 4, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row of ``docs`` (doc_id, text).

    ``train`` marks the rows to learn from; a null is false. A null text is empty: its end alone is scored. Repeated rows are
    scored (and learned from) each by itself. Without training rows the trees are even (a half for each bit) and base_score is 0.
    score: log10 of the trees' probability of the text's bytes and its end; bits_per_byte: its code length over bytes and end.

    Counts cover all training texts. The most frequent words and grams, up to ``limits``, are broadcast; tokens
    and grams that are not among them are joined with the counts, so nothing is left out at any size. A word that very many
    rows hold is among the first, however long it is."""
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6: a context and its byte are one number")
    spark = docs.sparkSession
    text = F.col("text").cast("binary").alias("text")
    counts = materialise(count_corpus(docs.select(text, F.coalesce(train, F.lit(False)).alias("train")), depth), "counts")
    words = counts.where("word is not null and n > 0").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    scale = total["n"] + 0.5 * (total["v"] + 1)
    value_of = lambda n: F.log10((n + 0.5) / F.lit(scale))
    hot = most_frequent(words, limits.words).select("word", value_of(F.col("n")).alias("value")).toArrow()
    hot_words = dict(zip(map(bytes, hot["word"].to_pylist()), hot["value"].to_pylist(), strict=True))
    grams = materialise(gram_scores(counts.where("gram is not null").select("gram", "n"), depth), "grams")
    hot = most_frequent(grams, limits.grams).select("gram", "value").toArrow()
    hot_grams = (hot["gram"].to_numpy().astype(np.int64), hot["value"].to_numpy().astype(np.float64))

    rows = materialise(score_rows(docs.select("doc_id", text), hot_words, hot_grams, depth), "scored")
    cold = rows.select("rid", F.explode("words").alias("word")).join(words, "word", "left")
    cold = cold.groupBy("rid").agg(F.count("n").alias("more_known"), F.sum(value_of(F.coalesce("n", F.lit(0)))).alias("more_base"))
    deep = rows.select("rid", F.explode("grams").alias("gram")).join(grams, "gram").groupBy("rid").agg(F.sum("value").alias("more_value"))
    out = rows.select("doc_id", "rid", "n_tokens", "known", "base", "value", "coded").join(cold, "rid", "left").join(deep, "rid", "left")
    score = F.col("value") + F.coalesce("more_value", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (score * (-1 / log10(2)) / F.col("coded")).alias("bits_per_byte"),
    )
