"""Exact top-k search over integer vectors by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG_MAX = 9.2e18


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id long, v array<long>): floor(scale * x) of each component as double.

    Left out: rows without id or vector, vectors that hold a null or non-finite component, and those
    whose squared norm passes 9.2e18 (the product of two others always fits a long). Of repeated rows of
    equal id and vector one counts. Ids name one vector each by contract: rows of one id with different vectors are candidates of
    their own, and as queries share one list."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    kept = (
        vectors.where("vec_id is not null and embedding is not null")
        .where(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))))
        .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c) < LONG_MAX)
    )
    return kept.select("vec_id", F.transform("x", lambda c: c.cast("long")).alias("v")).dropDuplicates(["vec_id", "v"])


def flat_vectors(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components one after another, and each vector's length."""
    parts = [x for x in vectors.chunks if len(x)]
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in parts]
    size = [np.diff(x.offsets.to_numpy()) for x in parts]
    return (np.concatenate(flat), np.concatenate(size)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def postings(ids: np.ndarray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sorted ids, and for each term the places and weights of the rows that have it; zero weights are no postings."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    flat, lengths = flat_vectors(vectors)
    row = np.repeat(place, lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = flat != 0
    flat, row, term = flat[some], row[some], term[some]
    by_term = np.lexsort((row, term))  # a term's places in order: one that every row has is added as a whole
    flat, row, term = flat[by_term], row[by_term], term[by_term]
    cut = np.flatnonzero(np.diff(term)) + 1
    starts = np.concatenate(([0], cut)) if len(term) else np.zeros(0, np.int64)
    return ids[order], {int(term[a]): (row[a:b], flat[a:b]) for a, b in zip(starts, np.concatenate((cut, [len(term)])), strict=False)}


def best_places(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        place = np.flatnonzero(score > least)
        place = np.concatenate((place, np.flatnonzero(score == least)[: k - len(place)]))
    else:
        place = np.arange(len(score))
    return place[np.lexsort((place, -score[place]))]


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query over all candidates.

    Both inputs are (vec_id, v array<long>) as ``quantise`` gives them. A candidate with the query's own
    id is left out; ties go to the smaller vec_id; with fewer candidates than k, all are returned;
    vectors of other lengths share only their common places. Empty inputs give no rows.

    Rows are hashed by id into blocks of about ``block`` candidates and ``query_block`` queries, and each pair
    of blocks is one group: a task holds two blocks of vectors and one dense score array, whatever the input's
    size. Each query row scatters its weighted postings into that array term by term; the block's k best are
    selected by partition, and the blocks' lists are merged by a window over at most k rows a block."""
    n_c, n_q = candidates.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n_c // block)), max(1, -(-n_q // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), every(c_blocks).alias("cb"))
    right = candidates.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).cast("int").alias("cb"), every(q_blocks).alias("qb"))

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and held.num_rows:
            ids, by_term = postings(held["vec_id"].to_numpy(), held["v"])
            score = np.empty(len(ids), np.int64)
            flat, lengths = flat_vectors(asked["v"])
            for query, weights in zip(asked["vec_id"].to_pylist(), np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
                score[:] = 0
                for term in np.flatnonzero(weights).tolist():
                    if term in by_term:
                        (places, values), weight = by_term[term], weights[term]
                        if len(places) == len(score):
                            score += weight * values
                        else:
                            score[places] += weight * values
                own = np.arange(np.searchsorted(ids, query), np.searchsorted(ids, query, "right"))
                top = best_places(score, k + len(own))
                top = top[~np.isin(top, own)][:k]
                out.append((np.full(len(top), query, np.int64), ids[top], score[top]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(tile, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
