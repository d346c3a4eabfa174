"""Token ids in files of a static range asymmetric numeral system.

One table of frequencies is counted over all ids and shared by all files. A file is a Parquet part: Spark's writers reach every store
and commit whole tasks, so a lost executor leaves no half file. Each of its rows is one segment of whole documents in ascending
doc_id order, in the binary layout below; a segment is cut into independent blocks whose lanes are coded together, and a
block has checkpoints from which a reader may start.

Segment, little-endian: b"RANS", version (1 byte), precision (1), 2 bytes of nothing, checksum of the table, number of documents,
number of blocks (4 each); lengths of the documents (4 each); the blocks; crc32 of all before it. Block: ids, lanes, steps
between checkpoints, checkpoints, words (4 each); states (8 each, lanes a checkpoint); word places; crc32 of each checkpoint's
ids as unsigned 32-bit integers; the words. Id t of a block is step t // lanes of lane t % lanes; a last step is filled up
with the most frequent id."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, map_batches, map_stream, materialise, own_dir
from tallyspark.llm.packing import Vocabulary, default_vocabulary, encoder

MAGIC, VERSION = b"RANS", 1
#: States lie in [LOW, 2**63); words of 32 bits leave or enter them, one a step at most.
LOW = np.uint64(1 << 31)
HALF = np.uint64(32)
HEAD, BLOCK_HEAD = struct.Struct("<4sBBHIII"), struct.Struct("<IIIII")


@dataclass(frozen=True)
class Shape:
    """Sizes of the format: ids of a segment and of a block, lanes, steps between checkpoints, ids of a file."""

    block: int = 1 << 20
    lanes: int = 1024
    steps: int = 256
    file: int = 64 << 20
    least_file: int = 2 << 20


@dataclass(frozen=True)
class Table:
    """Frequencies of ids, which sum to 2**precision; ``ids`` are ascending."""

    ids: np.ndarray
    freq: np.ndarray
    precision: int = 20

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.freq, dtype=np.uint64) - self.freq

    @cached_property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))

    @cached_property
    def place(self) -> np.ndarray:
        """Place in the table by id; -1 for an id that it has not."""
        at = np.full(int(self.ids[-1]) + 1 if len(self.ids) else 1, -1, np.int64)
        at[self.ids] = np.arange(len(self.ids))
        return at

    @cached_property
    def checksum(self) -> int:
        return zlib.crc32(self.freq.astype("<u8").tobytes(), zlib.crc32(self.ids.astype("<u4").tobytes()))

    @cached_property
    def most(self) -> int:
        return int(self.freq.argmax()) if len(self.freq) else 0


def table_of(counts: dict[int, int], precision: int = 20) -> Table:
    """Frequencies in proportion to ``counts``, one at least for each id; what rounding leaves goes to or comes from the largest.

    More ids than 2**precision are an error."""
    ids = np.array(sorted(i for i, n in counts.items() if n), np.int64)
    if len(ids) > 1 << precision:
        raise ValueError(f"{len(ids)} ids do not fit a table of 2**{precision}")
    if not len(ids):
        return Table(ids, np.zeros(0, np.uint64), precision)
    n = np.array([counts[i] for i in ids.tolist()], np.float64)
    freq = np.maximum(1, np.floor(n / n.sum() * (1 << precision))).astype(np.int64)
    over = int(freq.sum()) - (1 << precision)
    for i in np.argsort(-freq, kind="stable").tolist():
        take = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= take
        over -= take
        if not over:
            break
    return Table(ids, freq.astype(np.uint64), precision)


def encode_block(places: np.ndarray, table: Table, shape: Shape) -> bytes:
    """One block of table places; the last step comes first into the states, so that readers go forwards."""
    n = len(places)
    lanes = int(min(shape.lanes, max(1, n // 1024)))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, table.most, np.int64)
    grid[:n] = places
    ids = table.ids[grid[:n]].astype("<u4")
    freq, start = table.freq[grid].reshape(steps, lanes), table.starts[grid].reshape(steps, lanes)
    full = freq << np.uint64(63 - table.precision)
    shift, low = np.uint64(table.precision), np.uint64(0xFFFFFFFF)
    state = np.full(lanes, LOW)
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * steps
    states = []
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        over = state >= full[t]
        if over.any():
            out[t] = (state[over] & low).astype("<u4")
            state = np.where(over, state >> HALF, state)
        div = state // f
        state = (div << shift) + (state - div * f) + start[t]
        if t % shape.steps == 0:
            states.append(state)
    sizes = np.cumsum([0, *map(len, out)])
    places_of = np.arange(0, steps, shape.steps)
    words = np.concatenate(out)
    sums = np.array([zlib.crc32(ids[a * lanes : (a + shape.steps) * lanes].tobytes()) for a in places_of], "<u4")
    head = BLOCK_HEAD.pack(n, lanes, shape.steps, len(places_of), len(words))
    return b"".join([head, np.concatenate(states[::-1]).astype("<u8").tobytes(), sizes[places_of].astype("<u4").tobytes(), sums.tobytes(), words.tobytes()])


def _decode(states: np.ndarray, at: np.ndarray, words: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Table places of ``steps`` steps from each checkpoint (states: checkpoints x lanes), all of them side by side."""
    state, at = states.copy(), at.astype(np.int64)
    mask, shift = np.uint64((1 << table.precision) - 1), np.uint64(table.precision)
    out = np.empty((steps, *state.shape), np.uint32)
    for t in range(steps):
        slot = state & mask
        s = table.slots[slot]
        out[t] = s
        state = table.freq[s] * (state >> shift) + slot - table.starts[s]
        need = state < LOW
        if need.any():
            upto = np.cumsum(need, axis=1)
            state[need] = (state[need] << HALF) | words[(at[:, None] + upto - 1)[need]]
            at += upto[:, -1]
    return out.transpose(1, 0, 2)


def decode_block(data: memoryview, at: int, table: Table, first: int = 0, end: int | None = None) -> tuple[np.ndarray, int]:
    """Ids ``first`` to ``end`` of the block at byte ``at``, and the byte after the block. Only the checkpoints that hold them are decoded."""
    n, lanes, every, checks, n_words = BLOCK_HEAD.unpack_from(data, at)
    at += BLOCK_HEAD.size
    states = np.frombuffer(data, "<u8", checks * lanes, at).reshape(checks, lanes)
    at += states.nbytes
    word_at, sums = np.frombuffer(data, "<u4", checks, at), np.frombuffer(data, "<u4", checks, at + 4 * checks)
    at += 8 * checks
    words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
    after, end = at + 4 * n_words, n if end is None else min(end, n)
    if first >= end:
        return np.zeros(0, "<u4"), after
    steps, size = -(-n // lanes), every * lanes
    a, b = first // size, -(-end // size)
    whole = min(b, steps // every)
    parts = []
    if whole > a:
        parts.append(_decode(states[a:whole], word_at[a:whole], words, every, table).ravel())
    if b > whole:
        parts.append(_decode(states[whole:b], word_at[whole:b], words, steps - whole * every, table).ravel())
    ids = table.ids[np.concatenate(parts)][: n - a * size].astype("<u4")
    for k in range(a, b):
        if zlib.crc32(ids[(k - a) * size : (k - a + 1) * size].tobytes()) != sums[k]:
            raise ValueError(f"checkpoint {k}: ids do not have their checksum")
    return ids[first - a * size : end - a * size], after


def encode_segment(lengths: list[int], ids: np.ndarray, table: Table, shape: Shape = Shape()) -> bytes:
    """The documents' ids, one after another, as a segment. An id that the table has not is an error."""
    places = table.place[ids] if not len(ids) or int(ids.max()) < len(table.place) else np.array([-1])
    if len(places) and places.min() < 0:
        raise ValueError("an id is not in the table")
    blocks = [encode_block(places[a : a + shape.block], table, shape) for a in range(0, len(places), shape.block)]
    head = HEAD.pack(MAGIC, VERSION, table.precision, 0, table.checksum, len(lengths), len(blocks))
    whole = b"".join([head, np.array(lengths, "<u4").tobytes(), *blocks])
    return whole + zlib.crc32(whole).to_bytes(4, "little")


def segment_lengths(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4", HEAD.unpack_from(data, 0)[5], HEAD.size).astype(np.int64)


def decode_segment(data: bytes, table: Table, first: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a segment's documents, and their ids from ``first`` to ``end``. Another table, or bytes that changed, are an error."""
    magic, version, precision, _, checksum, docs, blocks = HEAD.unpack_from(data, 0)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    if (precision, checksum) != (table.precision, table.checksum):
        raise ValueError("the segment was written with another table")
    if zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("the segment does not have its checksum")
    lengths = segment_lengths(data)
    at, before, parts = HEAD.size + 4 * docs, 0, [np.zeros(0, "<u4")]
    end = int(lengths.sum()) if end is None else end
    for _ in range(blocks):
        n = BLOCK_HEAD.unpack_from(data, at)[0]
        found, at = decode_block(memoryview(data), at, table, max(0, first - before), max(0, end - before))
        parts.append(found)
        before += n
    return lengths, np.concatenate(parts)


def token_ids(docs: DataFrame, end_id: int = 2, vocabulary: Vocabulary | None = None, narrow: bool = True) -> DataFrame:
    """(doc_id, row, ids, counts): each row of ``docs`` (doc_id, text) as little-endian unsigned ids, ``end_id`` last; a null text is empty. No shuffle.

    Ids have 16 bits, or 32 unless ``narrow``; 16 must hold the vocabulary. Each task adds one row, without row number, whose counts are
    those of its ids: as many as the vocabulary at most."""
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    end, dtype = end_id.to_bytes(4, "little"), "<u2" if narrow else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, types = encoder(vocabulary), np.zeros(0, np.int64), [pa.null(), pa.int64(), pa.binary(), counts_type()]
        for batch in batches:
            types[0] = batch.schema.field("doc_id").type
            out = []
            for text in batch.column("text").to_pylist():
                ids = np.frombuffer(own.ids(text or "") + end, "<u4")
                if narrow and ids.max() > 0xFFFF:
                    raise ValueError("an id does not fit 16 bits")
                out.append(ids)
            if out:
                found = np.bincount(np.concatenate(out))
                if len(found) > len(total):
                    total, found = found.astype(np.int64), total
                total[: len(found)] += found
                columns = [batch.column("doc_id"), batch.column("row"), pa.array([x.astype(dtype).tobytes() for x in out], types[2]), pa.nulls(len(out), types[3])]
                yield pa.RecordBatch.from_arrays(columns, NAMES)
        if len(total):
            some = np.flatnonzero(total)
            counts = [{"id": i, "n": n} for i, n in zip(some.tolist(), total[some].tolist())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.nulls(1, types[2]), pa.array([counts], types[3])], NAMES)

    return map_stream(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), run, f"doc_id {kind}, row long, ids binary, counts array<struct<id: long, n: long>>")


NAMES = ["doc_id", "row", "ids", "counts"]


def counts_type() -> pa.DataType:
    return pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all rows: the sums of the tasks' counts, as many as the vocabulary at most. Ids themselves are not read."""
    counted = tokens.where("counts IS NOT NULL").select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def write_tokens(tokens: DataFrame, path: str, precision: int = 20, shape: Shape = Shape(), narrow: bool = True) -> None:
    """Writes ``tokens`` (as ``token_ids`` gives them, in a table, since it is read three times) as files below ``path``: the table of frequencies and the segments.

    Files follow one another in ascending doc_id (nulls first, then row). One shuffle, by ranges of doc_id and row, so that rows of one
    id, or without id, are dealt over many tasks. A task holds a segment: ``shape.block`` ids, or one longer document."""
    spark = tokens.sparkSession
    kind = tokens.schema["doc_id"].dataType.simpleString()
    counts = id_counts(tokens)
    table, total = table_of(counts, precision), sum(counts.values())
    spark.createDataFrame([(i, counts[i], f) for i, f in zip(table.ids.tolist(), table.freq.tolist())], "id long, n long, freq long").coalesce(1).write.parquet(f"{path}/table")
    files = max(1, -(-total // shape.file), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // shape.least_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        rows: list[int] = []
        held: list[bytes] = []
        size, width = 0, 2 if narrow else 4

        def segment() -> pa.RecordBatch:
            data = encode_segment([len(x) // width for x in held], np.frombuffer(b"".join(held), f"<u{width}"), table, shape)
            columns = [[part], [seq], [before], [size], [docs], [rows], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()))], ["part", "seq", "before", "n_tokens", "doc_ids", "rows", "data"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                rows.append(row)
                held.append(ids)
                size += len(ids) // width
                if size >= shape.block:
                    yield segment()
                    seq, before, size = seq + 1, before + size, 0
                    docs, rows, held = [], [], []
        if held:
            yield segment()

    schema = f"part int, seq long, before long, n_tokens long, doc_ids array<{kind}>, rows array<long>, data binary"
    ordered = tokens.where("counts IS NULL").select("doc_id", "row", "ids").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    map_stream(ordered, run, schema).write.option("compression", "uncompressed").parquet(f"{path}/segments")


def read_table(spark: SparkSession, path: str) -> Table:
    """The shared table, whose size is bounded by the vocabulary."""
    found = sorted((r["id"], r["freq"]) for r in spark.read.parquet(f"{path}/table").collect())
    freq = np.array([f for _, f in found], np.uint64)
    return Table(np.array([i for i, _ in found], np.int64), freq, int(freq.sum()).bit_length() - 1 if found else 20)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, start, n_tokens, ids) of every document, from the files: start counts the ids of all documents before it.

    Segments are decoded independently of each other. Starts need the sums of the files before, one number a file, which are broadcast;
    sums within a file are in its segments."""
    table = read_table(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            lengths, ids = decode_segment(batch.column("data")[k].as_py(), table)
            ends = np.cumsum(lengths)
            begun = ends - lengths
            docs, rows = batch.column("doc_ids")[k].values, batch.column("rows")[k].values
            offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64).tobytes())
            texts = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, offsets, pa.py_buffer(ids.tobytes())])
            start = pa.array(begun + batch.column("base")[k].as_py() + batch.column("before")[k].as_py(), pa.int64())
            yield pa.RecordBatch.from_arrays([docs, rows, start, pa.array(lengths, pa.int64()), texts.cast(pa.binary())], ["doc_id", "row", "start", "n_tokens", "ids"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    placed = segments.join(F.broadcast(bases), "part").select("before", "base", "doc_ids", "rows", "data")
    return map_stream(placed, every, f"doc_id {kind}, row long, start long, n_tokens long, ids binary")


def document_ids(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """(doc_id, row, ids) of a few documents: their segments are found by the ids they hold, and decoded from the checkpoints nearest to them."""
    table, wanted = read_table(spark, path), set(doc_ids)
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            data = batch.column("data")[k].as_py()
            lengths = segment_lengths(data)
            ends = np.cumsum(lengths)
            for i, (doc, row) in enumerate(zip(batch.column("doc_ids")[k].as_py(), batch.column("rows")[k].as_py())):
                if doc in wanted:
                    out.append((doc, row, decode_segment(data, table, int(ends[i] - lengths[i]), int(ends[i]))[1].tobytes()))
        kinds = (batch.schema.field("doc_ids").type.value_type, pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "row", "ids"])

    some = segments.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, doc_ids)))).select("doc_ids", "rows", "data")
    return map_batches(some, run, f"doc_id {kind}, row long, ids binary")


def store(docs: DataFrame, path: str | None = None, narrow: bool = True, **options) -> str:
    """Encodes ``docs`` (doc_id, text) into files; their path, one in the shared checkpoint folder unless given. The table of ids between is removed."""
    path = path or f"{own_dir(docs.sparkSession)}/rans-{uuid.uuid4().hex}"
    tokens = materialise(token_ids(docs, narrow=narrow), "ids", compression="zstd")
    write_tokens(tokens, path, narrow=narrow, **options)
    discard(tokens)
    return path
