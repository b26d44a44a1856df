"""Connected components: edges contracted where they lie, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kbspark.session import materialise

HEAVY_NODES = 1000
# Edges that one task contracts at a time, and so many are left to one task in the end.
LOCAL_EDGES = 500_000


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node it is connected to by the edges (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            # The root of either end is hung on the lesser root, then every node jumps to its root.
            np.minimum.at(label, before[side], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _stars(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(u, v): every node of the edges beside the least node of its component among them."""
    table = pa.Table.from_batches(edges)
    both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks()
    coded = both.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[np.asarray(coded.indices)]
    half = len(table)
    label = _least_labels(ends[:half], ends[half:], len(order))
    nodes = coded.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["u", "v"])


def _contracted(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stars of a task's edges, `piece` at a time: no more edges than nodes, or than came."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= piece:
                yield _stars(held)
                held, n = [], 0
        if n:
            yield _stars(held)

    return run


def _with_least(e: DataFrame, n: int, extra) -> DataFrame:
    """Edges (u, v) with m, the least of v over the u's edges; extra names what else m is held against.

    A node with more than 1 / HEAVY_NODES of the n edges would put them all in one task of a
    join; the at most HEAVY_NODES of these are sent to where the edges are, and only the other
    nodes' edges are shuffled. Least neighbours are combined before their shuffle.
    """
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", extra.alias("m"), "degree")
    most = n // HEAVY_NODES
    heavy = F.broadcast(least.where(F.col("degree") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    marked = e.join(heavy, F.col("u") == F.col("hub"), "left")
    at_hub = marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m"))
    return at_hub.unionByName(marked.where("hub is null").select("u", "v").join(least.select("u", "m"), "u"))


def _of_several(e0: DataFrame) -> DataFrame:
    """Edges of the nodes that several pieces have: only these can join pieces."""
    return e0.join(e0.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u"), "u", "left_semi")


def _hung_on(e0: DataFrame, n: int, hung: DataFrame) -> DataFrame:
    """(node, component) of all n stars (u, v), where hung (u, component) has what their roots came to.

    Roots of more than 1 / HEAVY_NODES of the stars are sent to where these are.
    """
    roots = e0.groupBy(F.col("v").alias("root")).agg(F.count("*").alias("n")).join(hung.select(F.col("u").alias("root"), "component"), "root", "left")
    roots = materialise(roots.select("root", "n", F.coalesce("component", "root").alias("component")))
    most = n // HEAVY_NODES
    heavy = F.broadcast(roots.where(F.col("n") > most).select(F.col("root").alias("hub"), F.col("component").alias("hub_component")))
    marked = e0.join(heavy, F.col("v") == F.col("hub"), "left")
    light = marked.where("hub is null").join(roots.where(F.col("n") <= most), F.col("v") == F.col("root")).select("u", "component")
    every = marked.where("hub is not null").select("u", F.col("hub_component").alias("component")).unionByName(light)
    return every.groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))


def components(edges: DataFrame, most_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its least node.

    First every task contracts the edges it has: union-find over LOCAL_EDGES (or local_edges) at a time leaves a
    star for each component among them. If they are more than one piece, only the nodes that
    several pieces have go on; all others hang on the root of their star. As soon as what is left
    fits one such piece, one task finishes. Until then rounds go on: a large-star step hangs every larger neighbour of a
    node on its least neighbour, a small-star step the smaller ones and the node itself, and
    what comes out is contracted again; the number of edges never grows and the rounds grow
    with the logarithm of the longest path. Every round is one table in the shared folder, so
    lineage stays short, and what tells that nothing moved is counted as the table is written.
    Self loops keep their node; no edges give no rows.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pair = f"u {kind}, v {kind}"

    def kept(x: DataFrame) -> tuple[DataFrame, tuple]:
        # Exact sums of 32-bit halves do not overflow; equal marks of two rounds mean nothing moved.
        h, seen = F.xxhash64("u", "v"), Observation()
        x = x.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))
        out = materialise(x)
        mark = seen.get
        return out, (mark["n"], mark["low"], mark["high"])

    contracted = _contracted(max(local_edges, LOCAL_EDGES))
    e, seen = kept(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(contracted, pair))
    e0, n0 = e, seen[0]
    if n0 > local_edges:
        e, seen = kept(_of_several(e0))
    for _ in range(most_rounds):
        if seen[0] <= local_edges:
            # A bounded number of edges: one task sees all of them.
            whole = e.repartition(1).mapInArrow(contracted, pair) if seen[0] else e
            hung = whole.select("u", F.col("v").alias("component"))
            break
        own = e.where("u <> v")
        ways = F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _with_least(own.select(ways), 2 * seen[0], F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, seen[0], F.col("m"))
        # A node's least neighbour takes its other ones, and the node itself.
        turned = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e, now = kept(turned.mapInArrow(contracted, pair))
        if now == seen:
            hung = e.groupBy("u").agg(F.min("v").alias("component"))
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if e is e0 and seen[0] <= local_edges:
        return hung.select(F.col("u").alias("node"), "component")
    return _hung_on(e0, n0, hung)
