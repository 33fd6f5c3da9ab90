"""Exact top-k by inner product: a KD-tree for each shard of the vectors, searched best first.

Shards are cut in space: a coarse tree of median splits over a bounded sample names cells, a cell with many
points is dealt into shards by hash, so equal points don't pile up. Within a shard a tree splits at the
median of the widest dimension and keeps the tight box of every node. A query's inner product with any
point of a box is at most the sum, over dimensions, of the larger product with the box's two ends. A query
first searches its home shard; the kth score found there goes with it, and it is sent on only to the cells
whose boxes can hold as much. Queries search in blocks: nodes are taken in the order of their best bound
for any query of the block, and a leaf is scored, as one matrix product, for the queries that it can serve.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.lineage import cut

#: Points in a shard, and queries in a block, on the average at most; points in a leaf at most.
SHARD_POINTS, BLOCK_QUERIES, LEAF_POINTS = 8192, 256, 128
#: Cells of a length of vectors at most, and numbers in all their boxes (so much the driver holds and sends); lengths that
#: are cut into cells at most. Points of further lengths share one cell, which is dealt by hash all the same.
CELLS, BOX_NUMBERS, LENGTHS = 1024, 1 << 20, 16
#: Numbers in the sample that the cells of a length are cut from, at most about.
SAMPLE_NUMBERS = 1 << 21


def _split(points: np.ndarray, order: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The widest dimension of points[order] and order parted at its median; None if they are all equal."""
    own = points[order]
    width = own.max(0) - own.min(0) if len(own) and own.shape[1] else np.zeros(1)
    axis = int(width.argmax())
    if not width[axis] > 0:
        return None
    middle = len(order) // 2
    parted = order[np.argpartition(own[:, axis], middle)]
    return axis, parted[:middle], parted[middle:]


class Tree:
    """ids, points (rows in tree order), and for node i its rows first[i]:last[i], box low[i], high[i] and
    children left[i], left[i] + 1 (0: a leaf)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_POINTS):
        order, nodes, left = np.arange(len(ids)), [(0, len(ids))], []
        low, high = [], []
        i = 0
        while i < len(nodes):
            a, b = nodes[i]
            own = points[order[a:b]]
            low.append(own.min(0) if b > a else np.zeros(points.shape[1]))
            high.append(own.max(0) if b > a else np.zeros(points.shape[1]))
            left.append(0)
            if b - a > leaf and (parts := _split(points, order[a:b])):  # points that are all equal stay in one leaf
                order[a:b] = np.concatenate(parts[1:])
                left[i] = len(nodes)
                nodes += [(a, a + len(parts[1])), (a + len(parts[1]), b)]
            i += 1
        self.ids, self.points = ids[order], points[order]
        self.first, self.last = (np.array(x) for x in zip(*nodes))
        self.left, self.low, self.high = np.array(left), np.array(low), np.array(high)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            tree.__dict__.update({k: z[k] for k in z.files})
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[list[list[tuple[float, int]]], int]:
        """Of each query (score, id) of the best k points with another id than its own, ties to smaller ids, of
        those that score at least its kth; and how many points were scored, queries together."""
        bounds = bounds_of(queries, self.low, self.high)
        kth, best = kth.astype(float).copy(), [[] for _ in queries]
        queue, scored = [(-bounds[:, 0].max(), 0)], 0
        while queue:
            node = heapq.heappop(queue)[1]
            active = np.flatnonzero(bounds[:, node] >= kth)  # kth may have risen since the node was queued
            if not len(active):
                continue
            if child := int(self.left[node]):
                for c in (child, child + 1):
                    if (bounds[active, c] >= kth[active]).any():
                        heapq.heappush(queue, (-bounds[active, c].max(), c))
                continue
            rows = slice(self.first[node], self.last[node])
            scores, ids = queries[active] @ self.points[rows].T, self.ids[rows]
            scored += scores.size
            hit = (scores >= kth[active, None]) & (ids != own[active, None])
            for j in np.flatnonzero(hit.any(1)).tolist():
                q, near = active[j], np.flatnonzero(hit[j])
                found = best[q] + list(zip((-scores[j, near]).tolist(), ids[near].tolist()))
                best[q] = heapq.nsmallest(k, found)
                if len(best[q]) == k:
                    kth[q] = max(kth[q], -best[q][-1][0])
        return [[(-s, i) for s, i in sorted(b)] for b in best], scored


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[queries, boxes]: what no point of a box exceeds."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Cells:
    """A coarse tree: splits (axis, value, below, from there on), where a child below 0 is cell -1 - child."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[list] = []
        self.n = 0
        self.root = self._grown(sample, np.arange(len(sample)), cells)

    def _grown(self, sample: np.ndarray, order: np.ndarray, cells: int) -> int:
        parts = _split(sample, order) if cells > 1 and len(order) > 1 else None
        if parts is None:
            self.n += 1
            return -self.n
        axis, a, b = parts
        here = len(self.splits)
        self.splits.append([axis, float(sample[b, axis].min()), 0, 0])
        self.splits[here][2] = self._grown(sample, a, cells // 2)
        self.splits[here][3] = self._grown(sample, b, cells - cells // 2)
        return here

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (on := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[on]).tolist():
                axis, value, below, above = self.splits[node]
                here = on[at[on] == node]
                at[here] = np.where(points[here, axis] < value, below, above)
        return -1 - at


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), dim)


def _placed(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, dim) with their cell."""
    for batch in batches:
        dims, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
        for dim in np.unique(dims).tolist():
            if dim in cells:
                rows = np.flatnonzero(dims == dim)
                cell[rows] = cells[dim].of(_matrix(batch.column(1).take(pa.array(rows)), dim))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])


def _grow(key: tuple, table: pa.Table) -> pa.Table:
    dim, cell, part = (int(x.as_py()) for x in key)
    ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    tree = Tree(ids, _matrix(table.column("v").combine_chunks(), dim))
    one = lambda x, kind: pa.array([x], kind)
    return pa.table({
        "dim": one(dim, pa.int32()), "cell": one(cell, pa.int32()), "part": one(part, pa.int32()), "tree": one(tree.dump(), pa.binary()),
        "low": one(tree.low[0].tolist(), pa.list_(pa.float64())), "high": one(tree.high[0].tolist(), pa.list_(pa.float64())),
    })


def _pack(table: pa.Table) -> pa.Table:
    """A block of queries in one row: dim, cell, part, ids, kth scores, vectors."""
    vectors = table.column("v").combine_chunks()
    return pa.table({
        **{c: table.column(c).slice(0, 1).cast(pa.int32()) for c in ("dim", "cell", "part")},
        "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
        "kth": pa.array([table.column("kth").to_pylist()], pa.list_(pa.float64())),
        "vs": pa.array([vectors.flatten().to_pylist()], pa.list_(pa.float64())),
    })


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            tree, ids = Tree.load(row["tree"].as_py()), np.array(row["ids"].as_py(), np.int64)
            queries = np.asarray(row["vs"].values.to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), row["dim"].as_py())
            hits, _ = tree.search(queries, ids, k, np.array(row["kth"].as_py()))
            found += [(own, i, int(s)) for own, best in zip(ids.tolist(), hits) for s, i in best]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _routed(batches: Iterator[pa.RecordBatch], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, dim, kth, ...) with the cells whose box can hold a score of kth."""
    for batch in batches:
        dims, kth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "kth"))
        cells: list[list[int]] = [[]] * batch.num_rows
        for dim in set(dims.tolist()) & boxes.keys():
            rows = np.flatnonzero(dims == dim)
            names, low, high = boxes[dim]
            bounds = bounds_of(_matrix(batch.column(1).take(pa.array(rows)), dim), low, high)
            for r, own in zip(rows.tolist(), bounds >= kth[rows, None]):
                cells[r] = names[own].tolist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])


def _cells(points: DataFrame) -> dict[int, Cells]:
    """Coarse trees of the most frequent lengths that fill several shards."""
    sizes = points.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_POINTS).filter("dim > 0")
    out = {}
    for row in sizes.orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        dim, n = row["dim"], row["n"]
        cells = max(1, min(CELLS, BOX_NUMBERS // dim, n // SHARD_POINTS))
        wanted = max(2, SAMPLE_NUMBERS // dim)
        hashed = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < min(1.0, wanted / n) * (1 << 30)
        # Many rows may share an id, and so a hash: the limit keeps the bound then.
        sample = points.filter((F.col("dim") == dim) & hashed).select("v").limit(2 * wanted).toArrow().column("v").combine_chunks()
        out[dim] = Cells(_matrix(sample, dim), cells)
    return out


def top_k(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k points with the largest inner product, for every query.

    Both tables have id (long) and v (array<double> of whole numbers, so that scores are exact while they
    are below 2**53); other columns are left out. A point with the query's id isn't its match. Ties go to
    the smaller id; with fewer points all are returned. Only vectors of the query's length are compared.
    Null ids, null vectors, and vectors with null or non-finite parts take no part. Repeated points count
    each; repeated queries are one query. Empty tables give an empty table. The sample that the cells are
    cut from is bounded; cells only decide how much is searched, never what is found.
    """
    whole = lambda df: df.filter("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    points = whole(points).select("id", "v", F.size("v").alias("dim"))
    queries = whole(queries).select("id", "v", F.size("v").alias("dim")).dropDuplicates(["id", "v"])
    cells = _cells(points)
    in_cells = lambda df: df.mapInArrow(lambda it: _placed(it, cells), "id long, v array<double>, dim int, cell int")
    shard = ["dim", "cell", "part"]

    placed = in_cells(points)
    parts = cut(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD_POINTS).cast("int").alias("parts")))
    own_part = F.pmod(F.xxhash64("id"), "parts").cast("int")
    trees = cut(
        placed.join(parts, ["dim", "cell"]).withColumn("part", own_part).groupBy(*shard)
        .applyInArrow(_grow, "dim int, cell int, part int, tree binary, low array<double>, high array<double>")
    )
    # A box a cell: of at most LENGTHS lengths CELLS cells, and one of each other length, which has to be searched anyway.
    ends = trees.filter(F.col("dim").isin([*cells])).select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "e"))
    ends = ends.groupBy("dim", "cell", "axis").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).orderBy("dim", "cell", "axis").toPandas()
    boxes = {}
    for dim, own in ends.groupby("dim"):
        boxes[int(dim)] = (own["cell"].to_numpy()[::dim].astype(np.int32), own["low"].to_numpy().reshape(-1, dim), own["high"].to_numpy().reshape(-1, dim))

    def searched(queries: DataFrame, of: DataFrame) -> DataFrame:
        """Queries (id, v, kth, and a shard) against their shards, in blocks; of: how many there are by cell."""
        per = of.select("dim", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_QUERIES)).cast("int").alias("blocks"))
        blocked = queries.join(per, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks"))
        packed = blocked.select("id", "v", "kth", "block", *shard).groupBy(*shard, "block").applyInArrow(_pack, "dim int, cell int, part int, ids array<long>, kth array<double>, vs array<double>")
        return packed.join(trees.drop("low", "high"), shard).mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")

    # Home: the shard that the query would lie in. A cell that holds no point has none, and nothing is known yet.
    asked = cut(in_cells(queries).join(parts, ["dim", "cell"], "left").withColumn("part", F.coalesce(own_part, F.lit(-1))))
    home = asked.filter("part >= 0").groupBy("dim", "cell", "part").agg(F.count("*").alias("n")).groupBy("dim", "cell").agg(F.max("n").alias("n"))
    first = cut(searched(asked.filter("part >= 0").withColumn("kth", F.lit(float("-inf"))), home))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    known = asked.join(kth, asked["id"] == kth["query_id"], "left").withColumn("kth", F.coalesce("least", F.lit(float("-inf")))).withColumnsRenamed({"cell": "home", "part": "home_part"})
    known = known.select("id", "v", "dim", "kth", "home", "home_part")
    routed = known.mapInArrow(lambda it: _routed(it, boxes), "id long, v array<double>, dim int, kth double, home int, home_part int, cells array<int>")
    only = F.when(F.col("dim").isin([*boxes]), F.col("cells")).otherwise(F.array(F.lit(0)))
    rest = routed.select("id", "v", "dim", "kth", "home", "home_part", F.explode(only).alias("cell"))
    counts = cut(rest.groupBy("dim", "cell").agg(F.count("*").alias("n")))
    rest = rest.join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("cell <> home OR part <> home_part")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.union(searched(rest, counts)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op5_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = F.transform("embedding", lambda x: F.when(F.abs(x) < float("inf"), F.floor(x.cast("double") * 256).cast("double")))
    points = vectors.select(F.col("vec_id").alias("id"), cells.alias("v"))
    return top_k(points, points.filter("id % 50 = 0"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
