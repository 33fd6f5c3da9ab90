"""Rank tests from counted values: against plain ranks of all rows, with hot values and far ones; no window over all values."""

import random
import re

import pytest

from parley.operators import inference


def plain_ranks(values):
    order = sorted(values)
    first, last = {}, {}
    for i, v in enumerate(order, 1):
        first.setdefault(v, i)
        last[v] = i
    return {v: (first[v] + last[v]) / 2 for v in first}


def sample(seed=6, n=400):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, 0.0, 0.0, rng.random(), -rng.random(), float(rng.randrange(5)), 2.0**60, -(2.0**-40), 1 - 2**-52, 1.0, 1 + 2**-52, None])
    return [(rng.choice("abs"), rng.choice(["p", "q"]), value(), rng.randrange(4)) for _ in range(n)]


SCHEMA = "g string, p string, v double, i int"


def test_mean_ranks(spark):
    rows = sample()
    got = {(r.p, r.v): (r["__n"], r["rank"], r["rank_ties"]) for r in inference.ranked_values(spark.createDataFrame(rows, SCHEMA), "v", ["p"]).collect()}
    for p in "pq":
        own = [v for _, q, v, _ in rows if q == p and v is not None]
        ranks = plain_ranks(own)
        assert {v: (own.count(v), r, own.count(v)) for v, r in ranks.items()} == {v: x for (q, v), x in got.items() if q == p}


def test_mann_whitney_by(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("p", "part")
    for r in inference.mann_whitney(df, "g", "v", "s", ["part"]).collect():
        a, b = ([v for g, q, v, _ in rows if q == r.part and g == name and v is not None] for name in (r.g, "s"))
        assert (r.n, r.n0) == (len(a), len(b)) and r.U == sum((x > y) + (x == y) / 2 for x in a for y in b)
        alone = inference.mann_whitney(df.filter((df.part == r.part) & df.g.isin(r.g, "s")), "g", "v", "s").first()
        assert alone.U == r.U and alone.p == pytest.approx(r.p, abs=1e-12)


def test_spearman(spark):
    rows = [r for r in sample() if r[2] is not None]
    for r in inference.spearman(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("p", "part"), "i", "v", ["part"]).collect():
        own = [(i, v) for _, q, v, i in rows if q == r.part]
        x, y = ([plain_ranks([o[k] for o in own])[o[k]] for o in own] for k in (0, 1))
        mx, my = sum(x) / len(x), sum(y) / len(y)
        rho = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
        assert r.n == len(own) and r.rho == pytest.approx(rho, abs=1e-9)


def test_no_window_over_all_values(spark):
    """Every window but the one over places is within a place of values."""
    df = spark.createDataFrame(sample(), SCHEMA)
    for out in (inference.mann_whitney(df, "g", "v", "s"), inference.kruskal(df, "g", "v", ["p"]), inference.spearman(df, "i", "v", ["p"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if re.search(r"\bWindow \[", line)]
        assert windows
        for line in windows:
            assert "__place" in line
            if "windowspecdefinition" in line and "__held" not in line:
                assert re.search(r"windowspecdefinition\([^)]*__place", line)


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", "p", None, 1), ("s", "p", float("nan"), 1), ("a", "p", float("inf"), 1), ("a", "p", float("-inf"), 1), ("s", "p", 0.0, 1)], SCHEMA)
    r = inference.mann_whitney(df, "g", "v", "s").first()
    assert (r.n, r.n0, r.U) == (2, 2, 1.0)  # NaN stands above all
    assert inference.mann_whitney(df.limit(0), "g", "v", "s").isEmpty() and inference.kruskal(df.limit(0), "g", "v", ["p"]).isEmpty()
