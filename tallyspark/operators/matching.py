"""Many needles in many texts: all needles are looked for in one map over the texts.

Needles are keyed by their heads, their first few characters. A text's windows of every head length get a rolling hash from one running
sum, since the multiplier has an inverse modulo 2**64; a bit map and a sorted array of the heads' hashes leave few places, and
there whole needles are looked up by the text itself. A hash that is hit by chance costs a look-up and no wrong answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLL = 0x9E3779B97F4A7C15
BACK = pow(ROLL, -1, 1 << 64)
#: Characters that are hashed at once, and bits of the map.
STEP, BITS = 1 << 18, 20
#: Characters of all needles, and needles, up to which they are sent to every task (some 200 MB of a task's memory).
MOST_CHARS, MOST = 16_000_000, 500_000


def powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(codes: np.ndarray, n: int, sums: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ``n`` characters, from running sums of characters times falling powers."""
    return (sums[n:] - sums[:-n]) * ahead[: len(codes) - n + 1]


@cache
def scales() -> tuple[np.ndarray, np.ndarray]:
    """Rising and falling powers for a step and a head beyond it."""
    return powers(ROLL, STEP + 256), powers(BACK, STEP + 256)


def running(codes: np.ndarray) -> np.ndarray:
    v = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(31)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(v * scales()[1][: len(codes)], out=out[1:])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Matcher:
    """Places of needles in texts; equal needles are one text with several numbers."""

    def __init__(self, needles: list[str], gram: int):
        """Heads have ``gram`` characters, 256 at most."""
        self.numbers: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            self.numbers.setdefault(needle, []).append(i)
        lengths: dict[str, set[int]] = {}
        for needle in self.numbers:
            lengths.setdefault(needle[:gram], set()).add(len(needle))
        by_size: dict[int, list[str]] = {}
        for head in lengths:
            by_size.setdefault(len(head), []).append(head)
        self.heads: list[tuple[int, np.ndarray, np.ndarray, list[list[int]], bool]] = []
        for n, heads in sorted(by_size.items()):
            codes = code_points("".join(heads))
            hashes = np.concatenate([windows(c, n, running(c), scales()[0]) for c in codes.reshape(-1, n)])
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[hashes >> np.uint64(64 - BITS)] = True
            same, merged = hashes[order], []
            first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(same)]):
                merged.append(sorted(set().union(*(lengths[heads[k]] for k in order[a:b].tolist()))))
            self.heads.append((n, bits, same[first], merged, len(same) == len(first) and all(x == [n] for x in merged)))

    def found(self, text: str) -> set[int]:
        """Numbers of all needles that lie in ``text``."""
        out: set[str] = set()
        for start in range(0, max(len(text), 1), STEP):
            codes = code_points(text[start : start + STEP + (self.heads[-1][0] if self.heads else 1) - 1])
            sums, ahead = running(codes), scales()[0]
            for n, bits, hashes, lengths, whole in self.heads:
                if len(codes) < n:
                    break
                own = windows(codes, n, sums, ahead)[:STEP]
                at = np.flatnonzero(bits[own >> np.uint64(64 - BITS)])
                if not len(at):
                    continue
                k = np.minimum(np.searchsorted(hashes, own[at]), len(hashes) - 1)
                hit = hashes[k] == own[at]
                at, k = at[hit], k[hit]
                if whole:  # one place is as good as many
                    k, first = np.unique(k, return_index=True)
                    at = at[first]
                for place, head in zip(at.tolist(), k.tolist()):
                    for size in lengths[head]:
                        piece = text[start + place : start + place + size]
                        if piece in self.numbers:
                            out.add(piece)
        return {i for piece in out for i in self.numbers[piece]}


def fits(needles: DataFrame) -> bool:
    """Whether ``needles`` (needle) may be sent to every task."""
    n, chars = needles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("needle").cast("long")), F.lit(0))).first()
    return n <= MOST and chars <= MOST_CHARS


def match_all(hays: DataFrame, needles: DataFrame, gram: int, form: Callable[[str], str] = str) -> DataFrame:
    """(hay_id, needle_id) for each row of ``hays`` (hay_id, hay) and of ``needles`` (needle_id, needle; not empty) that lies inside it. No shuffle.

    The needles go to every task, so their size must be checked first (``fits``); texts are read once, each in its ``form``."""
    spark = hays.sparkSession
    table = needles.select("needle_id", "needle").toArrow()
    sent = spark.sparkContext.broadcast((table["needle_id"].combine_chunks(), table["needle"].to_pylist()))
    made: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        if not made:
            made.append(Matcher(texts, gram))
        for batch in batches:
            rows: list[int] = []
            found: list[int] = []
            for i, text in enumerate(batch.column("hay")):  # one text at a time is Python's
                own = made[0].found(form(text.as_py()))
                rows += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column("hay_id").take(pa.array(rows, pa.int64())), ids.take(pa.array(found, pa.int64()))], ["hay_id", "needle_id"])

    kinds = hays.schema["hay_id"].dataType.simpleString(), needles.schema["needle_id"].dataType.simpleString()
    return hays.where("hay IS NOT NULL").select("hay_id", "hay").mapInArrow(run, f"hay_id {kinds[0]}, needle_id {kinds[1]}")
