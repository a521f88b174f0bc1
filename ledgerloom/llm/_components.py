"""Connected components by alternating large and small stars over Spark joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._util import forget, map_arrow, materialize

_PAIR = "u long, v long"


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges at hand, without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Edges of each batch as stars around the smallest node; what is connected stays so."""
    for b in batches:
        u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spanning(u, v)], ["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component): for each node of edges(u, v), the smallest node that it is connected with.

    Edges with a null end and loops are left out; a node without other edges isn't in the result. Every round keeps
    only edges, aggregates minima before it shuffles, and is written to the shared folder, so a lost executor costs
    one round at most. Raises RuntimeError if the graph hasn't settled after max_rounds (the number of rounds grows
    with the logarithm of the longest path). rows: of edges, if known.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).transform(map_arrow, _contract, _PAIR)
    edges = materialize(edges.distinct(), "edges", rows)
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if not state[0] or tuple(state) == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges, done = materialize(small, "edges", 2 * state[0]), edges
        forget(done)
    raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
