"""op5: against all products, with ties, copies and odd rows; the whole table is compared with DuckDB in test_oracles."""

import numpy as np

from parley.llm import kdtree


def brute(points, queries, k):
    out = []
    for q, v in queries:
        found = sorted((-float(np.dot(v, w)), i) for i, w in points if i != q)
        out += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, points, queries, k=5):
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kdtree.top_k(df(points), df(queries), k).collect())


def test_random_and_ties(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_POINTS", 150)
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    points = [(int(i), [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(700)]
    points += [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(300)]  # many copies
    queries = points[::20]
    assert run(spark, points, queries) == brute(points, queries, 5)


def test_tree():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 16):
        points = rng.integers(-50, 50, (500, dim)).astype(float)
        tree = kdtree.Tree.load(kdtree.Tree(np.arange(500), points, leaf=10).dump())
        for q in rng.integers(-50, 50, (20, dim)).astype(float):
            want = sorted((-float(p @ q), i) for i, p in enumerate(points) if i != 3)[:5]
            assert tree.search(q[None], np.array([3]), 5, np.array([-np.inf]))[0] == [[(-s, i) for s, i in want]]


def test_space_and_bounds(spark, monkeypatch):
    """Clustered points: cells are cut in space, and what the bounds rule out is neither sent nor scored."""
    monkeypatch.setattr(kdtree, "SHARD_POINTS", 100)
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (12, 8))
    points = [(i, [float(x) for x in centres[i % 12] + rng.integers(-5, 6, 8)]) for i in range(1800)]
    points += [(5000 + i, [7.0] * 8) for i in range(900)]  # a third of all are one point
    queries = points[::25] + [(-1, [0.0] * 8)]
    assert run(spark, points, queries) == brute(points, queries, 5)
    df = spark.createDataFrame(points, "id long, v array<double>").selectExpr("*", "size(v) AS dim")
    cells = kdtree._cells(df)[8]
    at = cells.of(np.array([v for _, v in points]))
    assert cells.n > 8 and at.min() >= 0 and at.max() < cells.n
    assert (np.bincount(at[:1800], minlength=cells.n) < 600).all()
    tree = kdtree.Tree(np.array([i for i, _ in points[:1800]]), np.array([v for _, v in points[:1800]]), leaf=20)
    asked = np.array([v for _, v in points[:1800:25]])
    _, scored = tree.search(asked, np.arange(0, 1800, 25), 5, np.full(len(asked), -np.inf))
    assert scored < 0.4 * len(asked) * 1800


def test_odd_rows(spark):
    points = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [3.0, 0.0]), (8, [])]
    assert run(spark, points, [(7, [3.0, 0.0]), (7, [3.0, 0.0]), (6, [1.0]), (2, None)]) == [(7, 1, 1, 3), (7, 2, 1, 3)]
    assert run(spark, [], []) == [] and run(spark, points, []) == []
    more = spark.createDataFrame([(7, [3.0, 0.0], "a", 1), (8, [1.0, 0.0], "b", 2)], "id long, v array<double>, score string, dim int")
    assert [(r.query_id, r.vec_id, r.score) for r in kdtree.top_k(more, more).collect()] == [(7, 8, 3), (8, 7, 3)]
