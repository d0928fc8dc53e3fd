"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm._common import forget, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges that are not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # hook the larger root of each edge under the smaller, then flatten
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), integers: the smallest node connected with it.

    Large-star and small-star steps alternate until nothing changes; each input partition first reduces its own edges to
    a forest. A step joins nothing and gathers no node's neighbours: stars are windows over the edges. The result of each round is
    written to the shared folder. Null ends and loops are left out; an empty table gives an empty result.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, size = [], [], 0

        def flush() -> pa.RecordBatch:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            size += batch.num_rows
            if size > 2_000_000:
                yield flush()
                a, b, size = [], [], 0
        if size:
            yield flush()

    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    now = materialize(edges.mapInArrow(reduce, "a long, b long"))
    while True:
        # large star: each node's larger neighbours go to its smallest neighbour, itself included
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m")))
        after = materialize(small.filter("a <> b").distinct())
        forget(now)
        # done when every node points at one node, and that node at none
        if after.groupBy("a").count().filter("count > 1").isEmpty() and after.select("b").distinct().join(after.select("a"), F.col("a") == F.col("b"), "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select("b", "b").distinct())
        now = after
