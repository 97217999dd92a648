"""Connected components of links between 64-bit nodes, by union-find in tasks and label rounds between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _forest(batches):
    """Union-find over a task's links; what comes out is at most one link per node, to its smallest known."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_numpy().tolist() for c in ("a", "b"))):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = np.array([n for n in parent if root(n) != n], np.int64)
    roots = np.array([root(int(n)) for n in nodes], np.int64)
    for begin in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(roots[begin : begin + 50_000]), pa.array(nodes[begin : begin + 50_000])], ["a", "b"])


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every node of links ``a``, ``b``.

    A round gives each node the smallest label among its own and its neighbours', then
    follows labels one step; rounds end when no label changes. Each is a stored table.
    """
    edges = materialize(links.select("a", "b").mapInArrow(_forest, "a long, b long"), "forest")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        better = labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = better.join(above, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        stored = materialize(jumped, "labels")
        labels = stored.select("node", "label")
        if stored.where("old <> label").isEmpty():
            return labels
