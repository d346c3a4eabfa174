"""Language identification as multilingual mixture inference.

Languages are unigram models over hashed character n-grams. A document is a mixture of them; its
proportions come from expectation-maximisation, and the set of languages from the likelihood less a
penalty for each further language: nested sets first, then languages dropped, added or exchanged while that helps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_batches, map_stream


@dataclass(frozen=True)
class LanguageModel:
    """names: the learned languages in order; log_p: float32 array, languages x buckets."""

    names: tuple[str, ...]
    log_p: np.ndarray
    buckets: int


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str, buckets: int) -> np.ndarray | None:
    """Hashed 1-, 2- and 3-grams of the lower-cased letters, other characters read as one blank; None without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    one = np.concatenate(([np.uint64(32)], points[keep], [np.uint64(32)]))
    two = one[:-1] * np.uint64(0x110000) + one[1:]
    three = two[:-1] * np.uint64(0x110000) + one[2:]
    return mixed(np.concatenate((one[one != 32], two, three)), buckets)


def mixed(codes: np.ndarray, buckets: int) -> np.ndarray:
    codes = codes * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(32)
    return ((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def train(labelled: DataFrame, buckets: int = 1 << 15, max_languages: int = 1024, smooth: float = 0.5) -> LanguageModel:
    """Counts n-grams over every row of ``labelled`` (text, lang) with neither null, for every label.

    Each task sends a row of counts a language; the table is languages x buckets numbers, which the driver and each worker
    hold (128 KB a language). More than ``max_languages`` labels are an error: no label is left out.
    An empty input gives a model without languages, which answers ``und`` for everything."""
    rows = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    names = tuple(sorted(r.lang for r in rows.select("lang").distinct().limit(max_languages + 1).collect()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages: their table would not fit; raise max_languages and the workers' memory")
    at = {name: i for i, name in enumerate(names)}

    def count(batches):
        total: dict[int, np.ndarray] = {}

        def told():
            for i, n in total.items():
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bucket", "n"])
            total.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (found := features(text, buckets)) is not None:
                    if len(total) > 256:
                        yield from told()
                    n = total.setdefault(at[lang], np.zeros(0, np.int64))
                    total[at[lang]] = np.bincount(found, minlength=buckets) if not len(n) else n + np.bincount(found, minlength=buckets)
        yield from told()

    counts = map_stream(rows, count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = np.zeros((len(names), buckets))
    if names:
        found = counts.toArrow()
        total[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    total += smooth
    return LanguageModel(names, np.log(total / total.sum(1, keepdims=True)).astype(np.float32), buckets)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 60, tolerance: float = 1e-4, enough: float = -np.inf) -> tuple[np.ndarray, float, float]:
    """EM for one document: p is features x languages, n the features' counts; proportions, log-likelihood, and a bound of the highest one.

    The likelihood is concave in the proportions, so each round's slopes bound what any proportions reach; once that is no more than ``enough``, it ends."""
    weight = np.full(p.shape[1], 1.0 / p.shape[1])
    total, last, bound = n.sum(), -np.inf, np.inf
    for _ in range(rounds):
        joint = p @ weight
        value = float(n @ np.log(joint))
        slope = ((n / joint) @ p) / total
        bound = min(bound, value + float(total * np.log(slope.max())))
        if bound <= enough or value - last < tolerance * max(1.0, abs(value)) * 1e-3:
            break
        last = value
        weight = weight * slope
    return weight, value, bound


def most_gained(p: np.ndarray, n: np.ndarray, weight: np.ndarray, chosen: list[int]) -> np.ndarray:
    """For each language, a bound of what the log-likelihood of ``chosen`` gains at most once it joins (the likelihood is concave in
    the proportions). For those of ``chosen``, of what EM has not reached yet."""
    joint = p[:, chosen] @ weight
    slope = ((n / joint) @ p) / n.sum()
    return n.sum() * np.log(np.maximum(slope, slope[chosen].max()))


def choose(p: np.ndarray, n: np.ndarray, best: int, alone: float, cost: float) -> tuple[list[int], np.ndarray]:
    """The set of languages of the highest log-likelihood less ``cost`` a further language, and their proportions.

    ``best`` is the likeliest single one and ``alone`` its value. Where no mixture can pay for a second one, it stays. Else nested sets
    in the order of the proportions of all are tried, then changes of the best one till none helps: a language more or less, or one in
    place of one or two. Sets that cannot win are left out by exact bounds."""
    chosen, weight, worth = [best], np.ones(1), alone
    whole, _, bound = mixture(p, n, enough=alone + cost)
    if bound <= alone + cost:
        return chosen, weight

    tried = {frozenset(chosen)}

    def attempt(languages: list[int]) -> bool:
        nonlocal chosen, weight, worth
        key = frozenset(languages)
        if not key or key in tried or bound - cost * (len(key) - 1) <= worth:
            return False
        tried.add(key)
        w, v, _ = mixture(p[:, languages], n, enough=worth + cost * (len(languages) - 1))
        if (v := v - cost * (len(languages) - 1)) <= worth + 1e-9 * abs(worth):
            return False
        chosen, weight, worth = languages, w, v
        return True

    order = [int(k) for k in np.argsort(-whole, kind="stable")]
    for size in range(2, len(order) + 1):
        attempt(order[:size])
    better = True
    while better:
        better = False
        now, reach = chosen, most_gained(p, n, weight, chosen)
        for k in [k for k in order if k not in now and reach[k] > cost]:
            better = attempt([*now, k]) or better
        for j in now if len(now) > 1 else []:
            better = attempt([k for k in now if k != j]) or better
        for gone in [g for size in (1, 2) for g in combinations(now, size)]:
            rest = [k for k in now if k not in gone]
            if not rest:
                continue
            w, v, _ = mixture(p[:, rest], n)
            reach = most_gained(p, n, w, rest)
            for k in [k for k in order if k not in now and v + reach[k] - cost * len(rest) > worth]:
                better = attempt([*rest, k]) or better
    return chosen, weight


def infer(text: str | None, model: LanguageModel, penalty: float) -> tuple[str, float, dict[str, float]]:
    """(language, its proportion, all proportions)."""
    found = features(text, model.buckets) if text and model.names else None
    if found is None:
        return "und", 0.0, {}
    grams, n = np.unique(found, return_counts=True)
    log_p = model.log_p[:, grams].astype(np.float64)
    top = log_p.max(0)
    alone = (log_p - top) @ n
    best = int(alone.argmax())
    if len(model.names) == 1:
        return model.names[0], 1.0, {model.names[0]: 1.0}
    chosen, weight = choose(np.exp(log_p - top).T, n, best, float(alone[best]), penalty * np.log(n.sum() + 1.0))
    main = int(weight.argmax())
    return model.names[chosen[main]], float(min(1.0, weight[main])), {model.names[k]: float(w) for k, w in zip(chosen, weight, strict=True)}


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 8.0) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): lang_pred, score (its proportion) and proportions.

    ``und`` with score 0 for a text that is null or has no letter, or where nothing was learned.
    Whole texts are read, whatever their length; equal texts get equal answers; only doc_id and
    text are read, so other columns cannot clash. No shuffle.
    penalty: what each further language must add to the log-likelihood, in units of the
    logarithm of the number of n-grams. n-grams overlap, so it is several times the half that
    independent draws would ask for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # languages x buckets floats: bounded by train()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [infer(t, sent.value, penalty) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64())),
            ],
            ["doc_id", "lang_pred", "score", "proportions"],
        )

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, proportions map<string,double>")
