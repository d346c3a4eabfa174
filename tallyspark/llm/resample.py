"""Importance resampling towards a target: hashed n-grams weigh each document, and the highest noisy scores are drawn.

Features are all runs of one to ``n`` words, hashed by crc32. A word's checksum is taken once; those of its runs follow from it, since the
checksum of joined bytes is that of the first part moved over the second's length, combined with the second's: tables of
numpy do the moving for whole batches of documents. Weights are sums over an array of gains a bucket; scores are whole numbers,
so an exact histogram of them gives the cutoff and every rank without sorting the documents as a whole."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import map_batches, map_stream, materialise, text_bytes, with_before

#: Lower-cases A-Z; what is no digit, letter or byte of a longer code point becomes a blank.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Lengths up to which moving a checksum is a table lookup.
SHORT = 64


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents with at least ``least_words`` are drawn; ``seed`` begins the text whose hash is a document's noise."""

    n: int = 3
    buckets: int = 10_000
    seed: int = 42
    percent: int = 5
    least_words: int = 20


@cache
def moves() -> np.ndarray:
    """[length, byte's place, byte]: what a byte of a checksum becomes when ``length`` bytes follow; by bytes, since moving is linear."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    out = np.empty((SHORT, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    for k in range(1, SHORT):
        out[k] = c[out[k - 1] & 255] ^ (out[k - 1] >> 8)
    return out


def moved(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of the same bytes as if ``lengths`` zero bytes followed, before those are added; lengths below ``SHORT``."""
    flat, at = moves().ravel(), lengths.astype(np.int64) * 1024
    out = flat[at + (sums & 255)]
    for k in (1, 2, 3):
        out ^= flat[at + (256 * k + ((sums >> np.uint32(8 * k)) & 255))]
    return out


def run_sums(words: list[bytes], n: int) -> list[np.ndarray]:
    """For 1 to ``n``: crc32 of each run of so many words joined by one blank, by the run's first word."""
    size = len(words)
    sums = np.fromiter(map(zlib.crc32, words), np.uint32, size)
    lengths = np.fromiter(map(len, words), np.int64, size)
    long = np.flatnonzero(lengths >= SHORT - 1)
    if len(long):
        lengths = np.where(lengths >= SHORT - 1, 0, lengths)
    blank = moved(np.full(size, zlib.crc32(b" "), np.uint32), lengths) ^ sums  # a blank and the word
    found = [sums]
    for k in range(2, n + 1):
        last = moved(found[-1][:-1], lengths[k - 1 :] + 1) ^ blank[k - 1 :] if size >= k else sums[:0]
        for i in {j for w in long.tolist() for j in range(w - k + 1, w + 1) if 0 <= j <= size - k}:
            last[i] = zlib.crc32(b" ".join(words[i : i + k]))
        found.append(last)
    return found


def batch_runs(texts: list[bytes | None], n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words of each text; for 1 to ``n`` the checksums of runs, and by them whether the run lies in one text (padded to the words)."""
    each = [(t or b"").translate(FOLD).split() for t in texts]
    counts = np.array([len(w) for w in each], np.int64)
    words = [w for own in each for w in own]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the end of the text
    return counts, run_sums(words, n), left


def feature_counts(texts: DataFrame, how: Resampling) -> np.ndarray:
    """Features in each bucket over all rows; a task sends one row a bucket at most, so the driver gets a number of rows that ``buckets`` bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            _, sums, left = batch_runs(batch.column("text").to_pylist(), how.n)
            for k, own in enumerate(sums):
                total += np.bincount(own[left[: len(own)] > k] % np.uint32(how.buckets), minlength=how.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    found = map_stream(text_bytes(texts), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(how.buckets, np.int64)
    out[[r["bucket"] for r in found]] = [r["n"] for r in found]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1,000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, how: Resampling) -> DataFrame:
    """(doc_id, n_words, n_features, weight) a row of ``docs`` (doc_id, text); weight is the sum of its features' gains. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sums, left = batch_runs(batch.column("text").to_pylist(), how.n)
        total = np.zeros(len(left) + 1, np.int64)
        for k, own in enumerate(sums):
            total[1 : len(own) + 1] += np.where(left[: len(own)] > k, gain[own % np.uint32(how.buckets)], 0)
        ends = np.cumsum(counts)
        upto = np.cumsum(total)
        n_features = sum(np.maximum(counts - k, 0) for k in range(how.n))
        columns = (counts, n_features, upto[ends] - upto[ends - counts])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(text_bytes(docs, "doc_id"), run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise of a document, a whole number of thousandths: from the first 8 hex digits of the hash of ``seed:doc_id`` (a null id is empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, how: Resampling) -> DataFrame:
    """``scored`` (doc_id, n_words, score and further columns; a table, as it is read several times) with rank: 1, 2, 3 ... by descending
    score, then doc_id (nulls last), for the drawn; null for the rest.

    The histogram of scores is summed from the top in two steps, over blocks of scores and within them. The sum above a score is the
    offset of its ranks; the last score whose sum is below the number to draw is the cutoff, the one number that the driver gets. Documents
    at or above it are numbered within their score: its group is small as far as the noise spreads equal weights, over some thousand scores."""
    able = scored.where(F.col("n_words") >= how.least_words)
    n, low, high = able.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    k = how.percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select("*", none)
    counted = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("down", F.lit(high) - F.col("score"))
    above = materialise(with_before(counted, [], "down", "n", max(4096, math.isqrt(high - low))).where(F.col("before") < k).select("score", "before"), "scores")
    cutoff = above.agg(F.min("score")).first()[0]
    drawn = (F.col("n_words") >= how.least_words) & (F.col("score") >= cutoff)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = scored.where(drawn).withColumn("_nth", F.row_number().over(order)).join(above, "score")
    ranked = ranked.withColumn("_rank", F.col("before") + F.col("_nth")).select(*scored.columns, F.when(F.col("_rank") <= k, F.col("_rank")).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select("*", none))


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Null and empty texts have no features and weigh 0. Rows of one doc_id are documents of their own with the same noise. An empty target, or
    empty ``docs``, has counts of 0. Other columns are not read. Texts are read twice, for the counts and for the weights."""
    gain = gains(feature_counts(docs, how), feature_counts(target, how))
    scored = weigh(docs, gain, how).withColumn("score", F.col("weight") + noise(how.seed))
    return draw(materialise(scored, "scored"), how)
