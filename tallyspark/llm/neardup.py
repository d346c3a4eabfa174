"""MinHash near-duplicates by tensored banding, with exact verification.

Two small collections of sub-keys (each of a few minhashes) are computed; table keys are pairs of one
sub-key from each, so m*m tables cost 2*m sub-keys. Texts that meet in a table form candidate clusters;
links are confirmed on full shingle sets within clusters, and components follow from the links."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, join_spread, map_stream, materialise, text_bytes
from tallyspark.llm.graph import components

U = np.uint64
#: Candidate ids and slots up to this many together are broadcast (some 100 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Banding:
    """percent: links have 100 * intersection >= percent * union. rows: minhashes a sub-key.

    tables a side follow from ``miss``: a pair at the threshold meets unless all sub-keys of one side differ."""

    words: int = 5
    percent: int = 80
    rows: int = 3
    miss: float = 5e-4
    seed: int = 11

    @property
    def side(self) -> int:
        return ceil(log(self.miss / 2) / log(1 - (self.percent / 100) ** self.rows))


class Words:
    """64-bit hashes of words, remembered while they are few."""

    def __init__(self, remember: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remember:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(out, U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(text: bytes | None, n: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence is one; none without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, U)
    h = words.of(parts)
    n = min(n, len(parts))
    out = np.full(len(parts) - n + 1, n, U)
    for i in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(parts) - n + 1 + i])
    return np.unique(out)


def node_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def multipliers(b: Banding) -> np.ndarray:
    return np.random.default_rng(b.seed).integers(1, 1 << 63, 2 * b.side * b.rows, dtype=np.uint64) * U(2) + U(1)


def sub_keys(found: np.ndarray, by: np.ndarray, b: Banding) -> np.ndarray:
    """2 * side keys: minhashes of each multiplier, ``rows`` of them hashed together with their place."""
    least = np.full(len(by), np.iinfo(U).max, U)
    for a in range(0, len(found), 4096):
        np.minimum(least, (by[:, None] * found[None, a : a + 4096]).min(1), out=least)
    grouped = least.reshape(2 * b.side, b.rows)
    key = np.arange(1, 2 * b.side + 1, dtype=U)
    for j in range(b.rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + grouped[:, j])
    return key


def signatures(docs: DataFrame, b: Banding) -> DataFrame:
    """(doc_id, n_shingles, node, h, keys): node names the shingle set, h is its first 64 bits; null node and no keys without words."""
    by = multipliers(b)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = Words()
        for batch in batches:
            if not batch.num_rows:
                continue
            n, node, h, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, b.words, words)
                n.append(len(found))
                node.append(node_of(found) if len(found) else None)
                h.append(int.from_bytes(node[-1][:8], "big", signed=True) if len(found) else None)
                keys.append(sub_keys(found, by, b).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(h, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "h", "keys"],
            )

    return map_stream(text_bytes(docs, "doc_id"), run, f"doc_id {kind}, n_shingles long, node binary, h long, keys array<long>")


def clusters(found: DataFrame, b: Banding) -> DataFrame:
    """(node, root): nodes that meet another one in some table, directly or through others."""
    sub = found.where("node is not null").select("node", "h", F.posexplode("keys").alias("at", "key"))
    shared = sub.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    keyed = found.where("node is not null").count() * 2 * b.side
    sub = join_spread(sub, shared, "key", "n", keyed).select("node", "h", "at", "key").distinct()
    side = lambda ok: F.collect_list(F.when(ok, F.col("key")))
    pairs = sub.groupBy("node", "h").agg(side(F.col("at") < b.side).alias("left"), side(F.col("at") >= b.side).alias("right"))
    tables = pairs.select("node", "h", F.explode("left").alias("l"), "right").select("node", "h", "l", F.explode("right").alias("r"))
    tables = tables.select("node", "h", F.xxhash64("l", "r").alias("t"))
    tables = materialise(tables, "tables")
    met = tables.groupBy("t").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("t", "first", "n")
    roots = components(join_spread(tables, met, "t", "n", tables.count()).select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())
    discard(tables)
    return roots


def places(found: DataFrame, grouped: DataFrame, b: Banding, docs_a_chunk: int = 256, shingles_a_chunk: int = 1 << 18) -> DataFrame:
    """(doc_id, node, slots): for one document of each clustered node, the groups and sides that compare it.

    A cluster is cut by size into bands whose sets can only reach the threshold within a band or with the
    next one, and bands by hash into chunks. Each pair of chunks that can hold links is a group, so groups have
    a bounded size and no pair of sets that met is left out. Clusters of one small chunk share groups."""
    own = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    own = own.join(grouped, "node").where("doc_id is not null")
    own = own.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(b.percent / 100)) + 1e-9).cast("int"))
    own = materialise(own, "clustered")
    per_band = own.groupBy("root", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    cuts = F.greatest(F.ceil(F.col("docs") / docs_a_chunk), F.ceil(F.col("total") / shingles_a_chunk)).cast("int")
    # Bands are some hundred a cluster at most: a factor of 0.8 apart.
    size = per_band.groupBy("root").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", cuts))).alias("cuts"))
    size = materialise(size, "cluster-sizes")
    small = (F.col("docs") <= docs_a_chunk) & (F.col("total") <= shingles_a_chunk)
    sums = size.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.when(small, F.col("total"))), F.lit(0)).alias("small")).first()
    bins = max(1, sums["small"] // (shingles_a_chunk // 2))
    bin_ = F.struct(F.xxhash64(F.lit("bin"), F.pmod(F.xxhash64("root"), F.lit(bins))).alias("group"), F.lit(0).alias("side"))
    own = join_spread(own, size, "root", "docs", sums["docs"])
    few = own.where(small).select("doc_id", "node", F.array(bin_).alias("slots"))
    large = own.where(~small)
    for step in (-1, 0, 1):
        large = large.withColumn(f"cuts{step + 1}", F.try_element_at("cuts", F.col("band") + step))
    large = large.withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts1")).cast("int"))

    def group(band, cut, other_band, other_cut):
        return F.xxhash64("root", band, cut, other_band, other_cut)

    def slots(step: int):
        each = F.when(F.col(f"cuts{step + 1}").isNotNull(), F.sequence(F.lit(0), F.col(f"cuts{step + 1}") - 1))
        band, cut = F.col("band"), F.col("cut")
        if step == 0:
            one = lambda c: F.struct(group(band, F.least(c, cut), band, F.greatest(c, cut)).alias("group"), F.when(c == cut, 0).when(c > cut, 1).otherwise(2).alias("side"))
        elif step == 1:
            one = lambda c: F.struct(group(band, cut, band + 1, c).alias("group"), F.lit(1).alias("side"))
        else:
            one = lambda c: F.struct(group(band - 1, c, band, cut).alias("group"), F.lit(2).alias("side"))
        return F.coalesce(F.transform(each, one), F.array().cast("array<struct<group:long,side:int>>"))

    many = large.select("doc_id", "node", F.concat(slots(-1), slots(0), slots(1)).alias("slots"))
    return few.unionByName(many)


def linked(node: list[bytes], side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among the sets (between sides 1 and 2; all where side is 0), by an inverted index."""
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    doc, flat = doc[order], flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    count = np.diff(np.concatenate((first, [len(flat)])))
    term = np.repeat(np.arange(len(first)), count)
    back = np.empty(len(flat), np.int64)
    back[order] = term
    cut = np.cumsum(size)[:-1]
    label = np.arange(len(sets))
    out = []
    for x, terms in enumerate(np.split(back, cut)):
        terms = terms[count[terms] > 1]
        if not len(terms):
            continue
        c = count[terms]
        at = np.repeat(first[terms] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
        both = np.bincount(doc[at], minlength=len(sets))
        both[: x + 1] = 0
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (size[x] + size - both)) & ((side[x] == 0) | (side != side[x])))
        for y in hit[label[hit] != label[x]]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((node[x], node[int(y)]))
    return out


def links(docs: DataFrame, placed: DataFrame, b: Banding) -> DataFrame:
    """(u, v): links between nodes that connect whatever the groups' full sets connect."""
    placed = materialise(placed, "placed")
    if (placed.agg(F.sum(1 + F.size("slots")).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    rows = text_bytes(docs, "doc_id").join(placed, "doc_id")

    def gather(batches):
        words = Words()
        for batch in batches:
            group, side, node, sets = [], [], [], []
            for text, name, slots in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                found = shingles(text, b.words, words)
                if node_of(found) == name:
                    for s in slots:
                        group.append(s["group"])
                        side.append(s["side"])
                        node.append(name)
                        sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(side, pa.int32()), pa.array(node, pa.binary()), pa.array(sets, pa.binary())], ["group", "side", "node", "set"])

    def compare(table: pa.Table) -> pa.Table:
        seen = {n: (s, x) for n, s, x in zip(table["node"].to_pylist(), table["side"].to_pylist(), table["set"].to_pylist(), strict=True)}
        node = sorted(seen)
        found = linked(node, np.array([seen[n][0] for n in node]), [np.frombuffer(seen[n][1], U) for n in node], b.percent)
        return pa.table({"u": pa.array([x for x, _ in found], pa.binary()), "v": pa.array([y for _, y in found], pa.binary())})

    sets = map_stream(rows.select("text", "node", "slots"), gather, "group long, side int, node binary, set binary")
    return sets.groupBy("group").applyInArrow(compare, "u binary, v binary")


def near_duplicates(docs: DataFrame, b: Banding = Banding()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    component_id: the smallest doc_id that links reach, its own included; kept: whether that is its own.
    Equal shingle sets are one node, so copies are neither compared nor expanded. Null, empty and blank
    texts have no shingles and link with nothing; so do rows without a doc_id (component null, kept).
    Repeated rows of one id get the same answer; other columns are not read; an empty table gives no rows.

    Candidates meet with probability 1 - ``miss`` at the threshold and more above it; links are confirmed on full
    sets of 64-bit shingle hashes, and no bucket, cluster or number of partners is capped."""
    found = materialise(signatures(docs, b), "signatures")
    grouped = clusters(found, b)
    roots = components(links(docs, places(found, grouped, b), b))
    named = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    names = found.where(named).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    names = materialise(names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "names")
    least = names.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    names = join_spread(names, least, "root", "nodes", names.count()).select("node", "component_id", "copies")
    out = join_spread(found.where(named).select("doc_id", "n_shingles", "node"), names, "node", "copies", found.count())
    alone = found.where(~named).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, b: Banding = Banding()) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which ``near_duplicates`` keeps the id: one document a group.

    Of repeated rows (equal id and text) one stays; rows without an id stay. Ids to remove are broadcast while they
    are at most ``BROADCAST_ROWS``; beyond that the join shuffles by id."""
    found = materialise(near_duplicates(docs, b), "components")
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone_n, again_n = gone.count(), again.count()
    out = docs.join(F.broadcast(gone) if gone_n <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
    if again_n:
        again = F.broadcast(again) if again_n <= BROADCAST_ROWS else again
        out = out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select(*docs.columns)
