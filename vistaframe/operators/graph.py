"""Connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.shared import written

#: Edges that a task gathers before it contracts them.
GATHERED = 1 << 18


def tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) but the least of its component, with that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b), those in each partition replaced by ties of each of its nodes to the least that they connect it to.

    A task holds two numbers for each of its nodes, however many edges come in."""

    def run(batches):
        none = np.empty(0, np.int64)
        held, new, n = (none, none), [], 0
        for batch in batches:
            new.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= max(GATHERED, len(held[0])):
                held, new, n = tied(*map(np.concatenate, zip(held, *new))), [], 0
        held = tied(*map(np.concatenate, zip(held, *new)))
        yield from pa.table([*map(pa.array, held)], names=["a", "b"]).to_batches(max_chunksize=1 << 16)

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node id connected to node by the edges (a, b).

    Each round lets a tie to a node that is tied itself go on to the least of that node's own, by an aggregation and a
    join, then brings the ties of each node together and contracts them where they are. A node has a tie for a task at
    most, so no neighbourhood is ever held in one place. The rounds end when nothing changes: then nodes are tied to their
    least only. Nodes are those that occur in an edge between two different nodes.
    """
    # written first, so that no task holds the Python workers of what makes the edges beside those of the contraction
    e = written(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")))
    e = written(contracted(contracted(e).repartition("a")))
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        low = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        on = e.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        e = written(contracted(on.repartition("a")))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
