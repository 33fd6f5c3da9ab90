"""Connected components of an edge table by contraction, all in joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.lineage import cut, release


#: So few edges are joined up by one task; more are contracted first.
LOCAL_EDGES = 15_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, next): every node of the edges and the least node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["at", "next"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of one component, and only they, share a root.

    Each round ranks the nodes anew by a hash, sends a node to the first of its neighbours and itself,
    follows that pointer once more, and replaces the edges by the distinct ones between different
    targets. Nodes that are first nowhere vanish; as the ranks are random, so does a fixed share of them
    a round, on long ordered chains as on stars. Once LOCAL_EDGES edges or fewer are left, one task joins
    them up. Per node only a minimum is kept: no neighbour list is gathered. Rounds are checkpointed; a
    lost executor costs one. Self-loops are allowed, nulls are not.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
    labels = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    edges, turn = edges.filter("a <> b"), 0
    while left := edges.limit(LOCAL_EDGES + 1).count():
        turn += 1
        if left <= LOCAL_EDGES:
            target = cut(edges.coalesce(1).mapInArrow(_united, "at long, next long"))
        else:
            target = _contracted(edges, turn)
        labels = cut(
            labels.join(target, labels["root"] == target["at"], "left").select("node", F.coalesce("next", "root").alias("root"))
        )
        if left <= LOCAL_EDGES:
            break
        one = target.select(F.col("at").alias("a"), F.col("next").alias("x"))
        two = target.select(F.col("at").alias("b"), F.col("next").alias("y"))
        edges = cut(
            edges.join(one, "a").join(two, "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        release(labels.sparkSession)
    return labels


def _contracted(edges: DataFrame, turn: int) -> DataFrame:
    """(at, next): where a round sends each node."""
    rank = lambda x: F.struct(F.xxhash64(F.lit(turn), x), F.col(x).alias("to"))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = cut(both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a"))["to"].alias("to")))
    again = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
    return cut(up.join(again, "to").select(F.col("a").alias("at"), F.col("next")))
