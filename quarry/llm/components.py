"""Connected components of a distributed edge list.

Each round contracts edges inside every task (union-find over that task's
edges only); nodes that got different roots in different tasks become the
edges of the next round, whose nodes are roots only.  Every root that is not
the smallest of its component is hooked to a smaller one per round, so the
number of open roots at least halves.  Nothing passes through the driver but
an emptiness test.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    for at in range(0, len(nodes), 65_536):
        part = nodes[at: at + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())],
                                         ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (two long columns): the
    smallest node of its component.  No edges: no rows."""
    names = edges.columns
    open_edges = edges.select(F.col(names[0]).alias("a"), F.col(names[1]).alias("b"))
    labels = None
    while True:
        local = written(open_edges.mapInArrow(_contract, "node bigint, root bigint"), "cc-local")
        least = local.groupBy("node").agg(F.min("root").alias("label"))
        step = written(least, "cc-step")
        open_edges = written(local.join(step, "node").where(F.col("root") != F.col("label"))
                             .select(F.col("label").alias("a"), F.col("root").alias("b")).distinct(), "cc-open")
        if labels is None:
            labels = step
        else:
            to = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = written(labels.join(to, "label", "left")
                             .select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        if open_edges.isEmpty():
            return labels
