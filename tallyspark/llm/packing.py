"""Best-fit packing by length histograms: the plan works on counts, and documents take planned slots by rank within length."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import map_batches, materialise, with_before

#: Fixed value: the text of the vocabulary's one special token.
SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class Vocabulary:
    """The two files of one byte-level vocabulary: as the ``tokenizers`` library reads it, and as ranks with its pattern."""

    json: str
    ranks: str
    pattern: str


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as ``tokenizers`` gives them.

    The ranks give the same ids several times faster. Left to ``tokenizers`` are texts that hold the special token's
    string, where alone the two differ, and those that the faster library refuses: its pattern gives up in a run of some
    hundred thousand blanks."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # With no special token the library looks for the empty pattern at every place of a text; this one occurs in none of its texts.
        self.plain = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: max(ranks.values()) + 1})
        self.whole = Tokenizer.from_file(vocabulary.json)

    def ids(self, text: str) -> bytes:
        if SPECIAL not in text:
            try:
                return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, row, piece, start, length, ids): each row of ``docs`` (doc_id, text) as token ids and ``end_id``, cut where longer than ``capacity``.

    The first piece takes what is over, the others have ``capacity`` ids. ``row`` tells rows of one doc_id apart. A null text
    is empty: one piece of ``end_id`` alone. Whole texts are encoded, however long and of whatever characters; ids are
    little-endian unsigned 32-bit. Other columns are not read. No shuffle."""
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        rows, piece, start, length, ids = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            whole = own.ids(text or "") + end
            n = len(whole) // 4
            a, b = 0, n % capacity or capacity
            for p in range(-(-n // capacity)):
                rows.append(i)
                piece.append(p)
                start.append(a)
                length.append(b - a)
                ids.append(whole[4 * a : 4 * b])
                a, b = b, b + capacity
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(rows)) for c in ("doc_id", "row")), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "row", "piece", "start", "length", "ids"],
        )

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return map_batches(numbered, run, f"doc_id {kind}, row long, piece int, start long, length long, ids binary")


def number_copies(packed: DataFrame) -> DataFrame:
    """``packed`` with copy in place of row: 0 for the first row of a doc_id, 1 for the next; rows without an id all count as the first."""
    order = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))).orderBy("row")
    return packed.withColumn("copy", (F.dense_rank().over(order) - 1).cast("int")).drop("row")


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths 1 to ``capacity``: placements and the number of bins.

    A placement (length, first rank, end rank, items a bin, first bin, offset) puts the items of those ranks
    into consecutive bins that are filled up to ``offset``. Bins of one filling are held as ranges, so time and
    the number of placements depend on ``capacity`` and not on the counts."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    placed, bins = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left, k = 0, counts[length], length
        while left:
            while k <= capacity and not room[k]:
                k += 1
            if k > capacity:
                k = capacity
                new = -(-left // (capacity // length))
                room[k].append((bins, new))
                bins += new
            first, n = room[k].pop()
            a_bin = k // length
            full = min(n, left // a_bin)
            if full:
                placed.append((length, rank, rank + full * a_bin, a_bin, first, capacity - k))
                room[k - a_bin * length].append((first, full))
                rank, left, first, n = rank + full * a_bin, left - full * a_bin, first + full, n - full
            if n and left:  # fewer items than one more bin would take
                placed.append((length, rank, rank + left, left, first, capacity - k))
                room[k - left * length].append((first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                room[k].append((first, n))
    return placed, bins


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any further columns) with sequence_id and offset of their planned slots.

    Every length must lie between 1 and ``capacity``. Sequences have no gaps; ids count from 0. An empty table
    gives an empty one; repeated rows take slots of their own. Columns named sequence_id or offset are an error.

    The histogram has at most ``capacity`` rows, so the plan is made by the driver and broadcast: its size is
    bounded by ``capacity`` alone. Ranks within a length are counted in parts of about 20,000 rows, dealt by a
    hash of the row, so a length that many rows share is no single task."""
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"pieces already have {sorted(clash)}")
    names = list(pieces.columns)
    pieces = materialise(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if bad := [x for x in counts if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    placed, _ = plan_bins(counts, capacity)
    shape = "length long, lo long, hi long, a_bin long, first long, filled long"
    plan = F.broadcast(pieces.sparkSession.createDataFrame(placed, shape))
    parts = max(1, sum(counts.values()) // 20_000)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", F.xxhash64(*names))
    base = with_before(dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), ["length"], "part", "n").drop("n")
    ranked = dealt.withColumn("rn", F.row_number().over(order)).join(base, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    nth = F.col("rank") - F.col("lo")
    slots = ranked.join(plan, "length").where("rank >= lo and rank < hi")
    return slots.select(*names, (F.col("first") + F.expr("(rank - lo) div a_bin")).alias("sequence_id"), (F.col("filled") + nth % F.col("a_bin") * F.col("length")).alias("offset"))
