"""Alignment of two tokenizers' tokens by byte offsets, in DuckDB for each block of an Arrow partition.

Both tokenizers cut a text at every lone blank (one between characters that are no white space): the byte-level pattern ends there, and
no piece has a blank behind another character. A text is therefore a list of stretches, each with the blank before it, and a stretch
that a block holds many times is tokenised and aligned once. In DuckDB each token of the block's distinct stretches is an interval of
bytes: an ASOF join finds the token of B in which one of A begins, a range join the tokens of B that begin inside one of A, and
running sums over the offsets where both end number the groups. Links become sums over a document's stretches.

A pair's corpus-wide count needs all documents. Blocks keep a document's pairs by number and send their distinct pairs with document
counts; Spark sums these, and each block gets the sums of its own pairs back. What is shuffled are distinct pairs a block, not links."""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialise
from tallyspark.llm.packing import Vocabulary, default_vocabulary, encoder

#: A blank at an end of the text or beside white space, and the blanks at which stretches end. Python's white space holds that of the tokenizers.
ODD, LONE = re.compile(r"(?:\A|\s) | (?:\s|\Z)"), re.compile(r"(?<=\S) (?=\S)")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Sides:
    """The two tokenizers' files, and the size of a block: bytes of text and rows, one row at least; DuckDB's memory in MB."""

    byte_level: Vocabulary = field(default_factory=default_vocabulary)
    pieces: str = field(default_factory=piece_model)
    block_bytes: int = 4 << 20
    block_rows: int = 4000
    duckdb_mb: int = 400


def stretches(text: str) -> list[str]:
    """Parts of ``text`` between lone blanks; joined by blanks they are the text."""
    return LONE.split(text) if ODD.search(text) else text.split(" ")


class Numbers(dict):
    """Numbers of keys in the order in which they come first."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


class ByteLevel:
    """A: byte-level ids of a blank and a stretch; strings of special tokens are plain text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.plain = vocabulary, encoder(vocabulary).plain
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.bytes = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.vocabulary.json)
        found.encode_special_tokens = True
        return found

    def one(self, text: str) -> np.ndarray:
        try:
            return self.plain.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except ValueError:  # its pattern gives up in very long runs of blanks
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in order, and how many each has. Parts without white space at their ends are encoded in one text, which is cut at their blanks."""
        inner = np.array([not (w[0].isspace() or w[-1].isspace()) for w in parts], bool)
        counts, held = np.zeros(len(parts), np.int64), [np.zeros(0, np.int32)] * len(parts)
        joined = [w for w, plain in zip(parts, inner.tolist()) if plain]
        if joined:
            ids = self.one(" " + " ".join(joined))
            ends = np.cumsum(self.lengths[ids])
            stops = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in joined), np.int64, len(joined)))
            at = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[np.minimum(at, len(ends) - 1)] == stops).all():
                if inner.all():
                    return ids, np.diff(at + 1, prepend=0)
                for k, own in zip(np.flatnonzero(inner).tolist(), np.split(ids, at[:-1] + 1)):
                    held[k] = own
            else:
                inner[:] = False
        for k in np.flatnonzero(~inner).tolist():
            held[k] = self.one(" " + parts[k])
        counts[:] = [len(x) for x in held]
        return np.concatenate(held), counts


class Pieces:
    """B: pieces, with U+2581 for a blank and <0xHH> for a byte; the blank before a stretch is the model's own."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("a piece has a blank behind another character, so texts cannot be cut at blanks")
        self.bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(parts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


@cache
def tokenizers(sides: Sides) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(sides.byte_level), Pieces(sides.pieces)


def intervals(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> pa.Table:
    """The token interval table of the good stretches: k (order), s (stretch), id, lo, hi (bytes, counted through all stretches)."""
    s = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    ids, s = ids[good[s]], s[good[s]]
    hi = np.cumsum(lengths[ids])
    return pa.table({"k": np.arange(len(ids)), "s": s, "id": ids, "lo": hi - lengths[ids], "hi": hi})


def whole_bytes(ids: np.ndarray, counts: np.ndarray, names: list[bytes], parts: list[str]) -> np.ndarray:
    """Which stretches' tokens join to the blank and the stretch."""
    each, ends = list(map(names.__getitem__, ids.tolist())), np.cumsum(counts).tolist()
    return np.fromiter((b"".join(each[a:b]) == b" " + w.encode() for a, b, w in zip([0, *ends], ends, parts)), bool, len(parts))


#: Tokens of A and B with the number of the group that they lie in; links; distinct pairs, numbered; pairs a stretch and a document.
GROUPED = """
CREATE OR REPLACE TEMP TABLE {t}g AS
SELECT k, s, id, lo, hi, CAST(coalesce(sum(cut) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
FROM (SELECT t.*, CAST(o.hi IS NOT NULL AS INT) AS cut FROM {t} t LEFT JOIN {o} o ON t.hi = o.hi)
"""
LINKS = """
CREATE OR REPLACE TEMP TABLE links AS
SELECT a.s, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
UNION ALL
SELECT x.s, x.id, y.id FROM (FROM b ANTI JOIN a ON a.lo = b.lo) y JOIN (FROM a ANTI JOIN b ON a.lo = b.lo AND a.hi = b.hi) x ON y.lo > x.lo AND y.lo < x.hi
"""
PAIRS = """
CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS p FROM (SELECT DISTINCT a, b FROM links);
CREATE OR REPLACE TEMP TABLE held AS SELECT s, p, count(*) AS m FROM links JOIN pairs USING (a, b) GROUP BY s, p;
CREATE OR REPLACE TEMP TABLE doc_pairs AS SELECT d, p, sum(n * m) AS t FROM occurs JOIN held USING (s) GROUP BY d, p
"""


@cache
def decimals(size: int) -> np.ndarray:
    """Texts of ids before a comma, a bar and a semicolon."""
    return np.array([[f"{i}{mark}" for i in range(size)] for mark in ",|;"], object)


def group_texts(a: dict, b: dict, n: int, sizes: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    """A stretch's groups as text, each ended by a semicolon, and how many it has. Both sides' tokens are put in order by their groups."""
    total = int(a["g"][-1]) + 1 if len(a["g"]) else 0
    a_end, b_end = np.searchsorted(a["g"], np.arange(total), "right"), np.searchsorted(b["g"], np.arange(total), "right")
    marks = decimals(max(sizes))
    out = np.empty(len(a["g"]) + len(b["g"]), object)
    a_mark, b_mark = np.zeros(len(a["g"]), np.int64), np.zeros(len(b["g"]), np.int64)
    a_mark[a_end - 1], b_mark[b_end - 1] = 1, 2
    out[np.arange(len(a["g"])) + np.concatenate([[0], b_end])[a["g"]]] = marks[a_mark, a["id"]]
    out[np.arange(len(b["g"])) + a_end[b["g"]]] = marks[b_mark, b["id"]]
    stops = (np.searchsorted(a["s"], np.arange(n), "right") + np.searchsorted(b["s"], np.arange(n), "right")).tolist()
    each = out.tolist()
    groups = np.bincount(a["s"][a_end - 1], minlength=n) if total else np.zeros(n, np.int64)
    return ["".join(each[x:y]) for x, y in zip([0, *stops], stops)], groups


def align_block(con, texts: list[str | None], sides: Sides) -> tuple[list[tuple], list[dict]]:
    """(n_a, n_b, n_groups, n_links, digest, numbers of its pairs, links a pair) of each text, and the block's pairs: ids, and how many of its texts hold them."""
    byte_level, pieces = tokenizers(sides)
    numbers = Numbers()
    codes = [np.fromiter(map(numbers.__getitem__, stretches(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    parts = list(numbers)
    n = len(parts)
    if not n:
        return [(0, 0, 0, 0, "", b"", b"")] * len(texts), []
    (a_ids, a_counts), (b_ids, b_counts) = byte_level.ids(parts), pieces.ids(parts)
    good = whole_bytes(a_ids, a_counts, byte_level.bytes, parts) & whole_bytes(b_ids, b_counts, pieces.bytes, parts)
    usable = np.array([len(c) > 0 and bool(good[c].all()) for c in codes], bool)
    doc = np.repeat(np.arange(len(codes)), [len(c) if ok else 0 for c, ok in zip(codes, usable)])
    every = np.concatenate([np.zeros(0, np.int64), *(c for c, ok in zip(codes, usable) if ok)])
    used, times = np.unique(doc * n + every, return_counts=True)
    views = {
        "ra": intervals(a_ids, a_counts, byte_level.lengths, good),
        "rb": intervals(b_ids, b_counts, pieces.lengths, good),
        "occurs": pa.table({"d": (used // n).astype(np.int32), "s": (used % n).astype(np.int32), "n": times}),
    }
    for name, rows in views.items():
        con.register(name, rows)
    con.execute("CREATE OR REPLACE TEMP TABLE a AS FROM ra; CREATE OR REPLACE TEMP TABLE b AS FROM rb")
    con.execute(GROUPED.format(t="a", o="b"))
    con.execute(GROUPED.format(t="b", o="a"))
    con.execute(LINKS)
    con.execute(PAIRS)
    a, b = (con.execute(f"SELECT s, id, g FROM {t}g ORDER BY k").fetchnumpy() for t in "ab")
    shown, groups = group_texts(a, b, n, (len(byte_level.bytes), len(pieces.bytes)))
    table = con.execute("SELECT a, b, count(*) AS n FROM doc_pairs JOIN pairs USING (p) GROUP BY a, b, p ORDER BY p").fetchnumpy()
    held = con.execute("SELECT d, p, t FROM doc_pairs ORDER BY d, p").fetchnumpy()
    renumber = np.unique(held["p"])  # pairs of stretches that no usable text has are left out
    p, t = np.searchsorted(renumber, held["p"]).astype("<u4"), held["t"].astype("<i8").astype("<u4")
    stops = np.searchsorted(held["d"], np.arange(len(texts)), "right").tolist()
    for name in views:
        con.unregister(name)
    out: list[tuple] = []
    for k, (c, ok) in enumerate(zip(codes, usable)):
        if not ok:
            out.append((0, 0, 0, 0, "", b"", b""))
            continue
        x, y = stops[k - 1] if k else 0, stops[k]
        digest = hashlib.sha256("".join(map(shown.__getitem__, c.tolist()))[:-1].encode()).hexdigest()
        out.append((int(a_counts[c].sum()), int(b_counts[c].sum()), int(groups[c].sum()), int(t[x:y].sum(dtype=np.int64)), digest, p[x:y].tobytes(), t[x:y].tobytes()))
    return out, [{"a": i, "b": j, "n": m} for i, j, m in zip(table["a"].tolist(), table["b"].tolist(), table["n"].tolist())]


def blocks_of(batch: pa.RecordBatch, sides: Sides) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``block_bytes`` of text and ``block_rows`` rows at most; one row at least."""
    sizes = np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column("text")], np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > sides.block_bytes or i - start >= sides.block_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def align_blocks(docs: DataFrame, sides: Sides) -> DataFrame:
    """(block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, table): one row a row of ``docs`` (doc_id, text); the first of a block has its pairs. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first, count = (TaskContext.get().partitionId() << 32), 0
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": f"{sides.duckdb_mb}MB", "temp_directory": spill}) as con:
            for batch in batches:
                for part in blocks_of(batch, sides):
                    rows, table = align_block(con, part.column("text").to_pylist(), sides)
                    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                    own = pa.array([table, *[None] * (len(rows) - 1)], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])))
                    block = pa.array([first + count] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([block, part.column("doc_id"), *columns, own], ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "table"])
                    count += 1

    shape = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, table array<struct<a: int, b: int, n: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold a pair of ids linked, and whether no pair of the same A id is in more. Sums of the blocks' partial counts."""
    pairs = aligned.where("table IS NOT NULL").select(F.inline("table"))
    counted = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, sides: Sides | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    Null and empty texts, and texts that either tokenizer does not keep byte for byte, have zeros and an empty digest, and count in no
    pair. Rows of one doc_id are documents of their own. Other columns are not read. A block is one group of the last step: its size is
    bounded by ``sides``, or one longer text; a pair occurs once a block at most, so no key of a join is hot beyond the number of blocks."""
    sides = sides or Sides()
    aligned = materialise(align_blocks(docs, sides), "aligned", compression="zstd")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = aligned.where("table IS NOT NULL").select("block", F.posexplode("table").alias("p", "pair")).select("block", "p", "pair.a", "pair.b")
    told = own.join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("of_block"), "p", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = right["p"].to_numpy()
        count, best = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        count[p], best[p] = right["count"].to_numpy(), right["best"].to_numpy()
        sums: tuple[list[int], list[int]] = ([], [])
        for pairs, times in zip(left["pairs"].to_pylist(), left["times"].to_pylist()):
            at, t = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums[0].append(int((t * best[at]).sum()))
            sums[1].append(int((t * count[at]).sum()))
        return pa.table({c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()), "groups_sha256": left["groups_sha256"]})

    shape = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.drop("table").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(run, shape)
