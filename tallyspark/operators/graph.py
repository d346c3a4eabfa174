"""Parent graphs and bounded layouts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.tables import materialise


def on_cycles(edges_of: DataFrame, child: str, parent: str) -> DataFrame:
    """Nodes that lie on, or between, cycles of a parent graph (child, parent).

    What stays is exactly the part that no order of the nodes can place. Where no child has two parents, ways are
    doubled, so rounds grow with the logarithm of the longest chain. Else each round drops the edges whose parent
    has no parent left, or whose child no child, until nothing changes, however many rounds that takes. Every round is
    written to the shared checkpoint folder: no lineage grows and no executor's cache is needed. Joins are merges: what a round keeps
    grows with the graph, and its packed size would have it broadcast through the driver in each round."""
    edges = edges_of.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct()
    edges = materialise(edges, "cycle-edges")
    n = edges.count()
    if edges.select("c").distinct().count() == n:
        edges = on_functional_cycles(edges, n)
        return edges.select(F.col("c").alias("node"))
    while n:
        up, down = edges.select(F.col("c").alias("p")).distinct(), edges.select(F.col("p").alias("c")).distinct()
        edges = materialise(edges.join(up.hint("merge"), "p", "left_semi").join(down.hint("merge"), "c", "left_semi"), "cycle-edges")
        left = edges.count()
        if left == n:
            break
        n = left
    return edges.select(F.col("c").alias("node")).unionByName(edges.select(F.col("p").alias("node"))).distinct()


def on_functional_cycles(edges: DataFrame, n: int) -> DataFrame:
    """The edges (c, p) of cycles, each node having one parent at most.

    After a way of n steps or more every node that still has an ancestor is at one on a cycle, and every node of a cycle is reached."""
    ways, steps = edges, 1
    while steps < n:
        ways = materialise(ways.join(ways.select(F.col("c").alias("p"), F.col("p").alias("q")).hint("merge"), "p").select("c", F.col("q").alias("p")), "cycle-ways")
        steps *= 2
    return edges.join(ways.select(F.col("p").alias("c")).distinct().hint("merge"), "c", "left_semi")


def cycle_components(edges_of: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, component) of every node that lies on a cycle of a graph (child, parent): its strongly connected component, named by the largest node.

    Nodes between cycles have no row. Three steps take turns until no edge is left. Edges that begin at a source or end at a sink go. Nodes with one
    edge in and one out are bridged: their ways are doubled to the next branching node on both sides, so a chain of any length takes a logarithm of
    rounds. What neither changes is coloured: the largest node spreads forwards, and what reaches it backwards in its colour is its component. Then
    bridged nodes take the component that their bridge's two ends share. Every round is written to the shared checkpoint folder."""
    edges = edges_of.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("c is not null and p is not null").distinct()
    loops = [edges.where("p = c").select(F.col("p").alias("node"))]
    edges = materialise(edges.where("p <> c"), "scc-edges")
    empty = edges.select(F.col("p").alias("node"), F.col("p").alias("component")).limit(0)
    found, bridges, n = empty, [], edges.count()
    while n:
        before = n
        edges = trimmed(edges)
        edges, bridge, loop, closed = bridged(edges)
        bridges.append(bridge)
        loops.append(loop)
        found = found.unionByName(closed)
        n = edges.count()
        if n and n == before:
            told = coloured(edges)
            found = found.unionByName(told)
            gone = told.select("node")
            edges = materialise(edges.join(gone.withColumnRenamed("node", "p"), "p", "left_anti").join(gone.withColumnRenamed("node", "c"), "c", "left_anti"), "scc-edges")
            n = edges.count()
    sized = found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    found = materialise(sized.where("n > 1").select("node", "component"), "scc-found")
    looped = reduce(DataFrame.unionByName, loops).distinct()
    found = materialise(found.unionByName(looped.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))), "scc-found")
    for bridge in reversed(bridges):
        ends = bridge.join(found.select(F.col("node").alias("back"), F.col("component").alias("_a")), "back").join(found.select(F.col("node").alias("fwd"), F.col("component").alias("_b")), "fwd")
        found = materialise(found.unionByName(ends.where("_a = _b").select("node", F.col("_a").alias("component"))), "scc-found")
    names = found.groupBy("component").agg(F.max("node").alias("_name"))
    return found.join(names, "component").select("node", F.col("_name").alias("component"))


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (p, c) whose parent has an edge in and whose child has one out."""
    inner = edges.select(F.col("c").alias("p")).distinct()
    outer = edges.select(F.col("p").alias("c")).distinct()
    return materialise(edges.join(inner, "p", "left_semi").join(outer, "c", "left_semi"), "scc-edges")


def bridged(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges between branching nodes alone; the bridged nodes (node, back, fwd); branching nodes that a bridge leads back to; and cycles of
    bridged nodes alone (node, component)."""
    single = lambda at, other, name: edges.groupBy(F.col(at).alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min(other).alias(name)).where("_n = 1").drop("_n")
    ways = materialise(single("c", "p", "back").join(single("p", "c", "fwd"), "node").withColumn("top", F.col("node")), "scc-ways")
    total, steps = ways.count(), 1
    while steps < total:
        further = ways.select(F.col("node").alias("_f"), F.col("fwd").alias("_fwd"), F.col("top").alias("_top"))
        nearer = ways.select(F.col("node").alias("_b"), F.col("back").alias("_back"))
        both = ways.join(further, F.col("fwd") == F.col("_f"), "left").join(nearer, F.col("back") == F.col("_b"), "left")
        ways = materialise(both.select("node", F.coalesce("_back", "back").alias("back"), F.coalesce("_fwd", "fwd").alias("fwd"), F.greatest("top", F.coalesce("_top", "top")).alias("top")), "scc-ways")
        steps *= 2
    inner = ways.select("node")
    alone = ways.join(inner.withColumnRenamed("node", "fwd"), "fwd", "left_semi")
    bridge = ways.join(inner.withColumnRenamed("node", "fwd"), "fwd", "left_anti").select("node", "back", "fwd")
    kept = edges.join(inner.withColumnRenamed("node", "p"), "p", "left_anti").join(inner.withColumnRenamed("node", "c"), "c", "left_anti")
    made = kept.unionByName(bridge.select(F.col("back").alias("p"), F.col("fwd").alias("c"))).distinct()
    made = materialise(made, "scc-edges")
    return made.where("p <> c"), bridge, made.where("p = c").select(F.col("p").alias("node")), alone.select("node", F.col("top").alias("component"))


def coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of the components whose largest node no larger one reaches; one for each colour, single nodes too."""
    nodes = edges.select(F.col("p").alias("node")).unionByName(edges.select(F.col("c").alias("node"))).distinct()
    colours = materialise(nodes.withColumn("colour", F.col("node")), "scc-colours")
    while True:
        reach = edges.join(colours.select(F.col("node").alias("p"), F.col("colour").alias("_of")), "p").groupBy(F.col("c").alias("node")).agg(F.max("_of").alias("_of"))
        new = materialise(colours.join(reach, "node", "left").select("node", F.greatest("colour", "_of").alias("colour"), (F.coalesce("_of", "colour") > F.col("colour")).alias("moved")), "scc-colours")
        colours = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    own = colours.withColumnRenamed("node", "_x")
    inside = edges.join(own.select(F.col("_x").alias("p"), F.col("colour").alias("_p")), "p").join(own.select(F.col("_x").alias("c"), F.col("colour").alias("_c")), "c").where("_p = _c").select("p", "c")
    inside = materialise(inside, "scc-inside")
    back = materialise(colours.where("node = colour"), "scc-back")
    n = back.count()
    while True:
        more = inside.join(back.select(F.col("node").alias("c"), "colour"), "c").select(F.col("p").alias("node"), "colour")
        back = materialise(back.unionByName(more).distinct(), "scc-back")
        grown = back.count()
        if grown == n:
            return back.select("node", F.col("colour").alias("component"))
        n = grown


def layout(nodes: DataFrame, edges: DataFrame, diagram: str, per_row: int = 5) -> DataFrame:
    """(diagram, node, rank, row, column) of small diagrams: rank is the longest way from a source; nodes of a cycle
    follow the last rank; within a rank, nodes go by the mean place of their parents, then as given; ``per_row`` a row.

    nodes (diagram, node, place), edges (diagram, source, target). A diagram is bounded by contract (some ten nodes), so
    each is one group."""

    def place(nodes: list[dict], pairs: list[dict]) -> list[tuple]:
        order = list(dict.fromkeys(x["node"] for x in sorted(nodes, key=lambda x: (x["place"], x["node"]))))
        parents: dict = {x: set() for x in order}
        for e in pairs or []:
            if e["source"] in parents and e["target"] in parents and e["source"] != e["target"]:
                parents[e["target"]].add(e["source"])
        rank: dict = {}
        while ready := [x for x in order if x not in rank and parents[x] <= rank.keys()]:
            rank |= {x: max((rank[s] + 1 for s in parents[x]), default=0) for x in ready}
        last = max(rank.values(), default=-1)
        rank |= {x: last + 1 for x in order if x not in rank}
        spot, out, row = {}, [], 0
        for r in sorted(set(rank.values())):
            level = [x for x in order if rank[x] == r]
            middle = {x: [spot[s] for s in parents[x] if s in spot] for x in level}
            level.sort(key=lambda x: (sum(middle[x]) / len(middle[x]) if middle[x] else order.index(x), order.index(x)))
            for i, x in enumerate(level):
                spot[x] = i % per_row
                out.append((x, r, row + i // per_row, i % per_row))
            row += -(-len(level) // per_row)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, columns = [], [[], [], [], []]
            for i, (n, e) in enumerate(zip(batch.column("nodes").to_pylist(), batch.column("edges").to_pylist(), strict=True)):
                for placed in place(n, e):
                    key.append(i)
                    for column, value in zip(columns, placed, strict=True):
                        column.append(value)
            node = pa.array(columns[0], batch.schema.field("nodes").type.value_type.field("node").type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key, pa.int64())), node, *(pa.array(c, pa.int32()) for c in columns[1:])], [diagram, "node", "rank", "row", "column"])

    kind = lambda c: nodes.schema[c].dataType.simpleString()
    left = nodes.groupBy(F.col(diagram).alias("d")).agg(F.collect_list(F.struct("node", "place")).alias("nodes"))
    right = edges.groupBy(F.col(diagram).alias("of")).agg(F.collect_list(F.struct("source", "target")).alias("edges"))
    both = left.join(right, F.col("d") == F.col("of"), "left").select("d", "nodes", "edges")
    return both.mapInArrow(run, f"`{diagram}` {kind(diagram)}, node {kind('node')}, rank int, row int, column int")
