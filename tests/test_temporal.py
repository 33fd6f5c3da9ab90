"""Joins in time and frames on odd rows against plain loops; streams against batch, late rows counted."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import temporal
from parley.streaming import events as stream

DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else DAY + dt.timedelta(seconds=seconds)


def table(spark, rows):
    return spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "k string, ts timestamp_ntz, i long")


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    rng = random.Random(1)
    make = lambda n, base: [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(0, 4000, 50)]), base + i) for i in range(n)]
    left, right = make(300, 0), make(150, 1000)
    left += left[:5]
    got = temporal.asof(table(spark, left), table(spark, right), ["k"], "ts", 300, "i", strict=strict)
    assert got.columns == ["k", "ts", "i", "last_ts", "last_i"]
    want = []
    for k, t, i in left:
        near = [(u, j) for q, u, j in right if k is not None and q == k and None not in (t, u) and (u < t or u == t and not strict) and t - u <= 300]
        best = max(near, default=(None, None))
        want.append((k, at(t), i, at(best[0]), best[1]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    none = temporal.asof(table(spark, left), table(spark, right).limit(0), ["k"], "ts", 300, "i")
    assert none.count() == len(left) and none.filter("last_i IS NOT NULL").isEmpty()
    assert temporal.asof(table(spark, left).limit(0), table(spark, right), ["k"], "ts", 300, "i").isEmpty()


def test_asof_deals_a_hot_key(spark):
    """One key's rows are in as many groups as there are buckets."""
    rows = spark.range(20_000).select(F.lit("a").alias("k"), (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.col("id").alias("i"))
    out = temporal.asof(rows, rows.filter("i % 7 = 0"), ["k"], "ts", 100, "i")
    assert out.filter("last_i = i - i % 7").count() == 20_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__bucket" in plan.split("hashpartitioning(k", 1)[1][:40]


def test_interval(spark):
    rng = random.Random(2)
    spans = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 9000, 7)]), rng.choice([None, 0, -5, 1, 60, 3000, 10**6]), i) for i in range(200)]
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 9000, 7)]), i) for i in range(300)]
    s = spark.createDataFrame([(k, at(a), None if None in (a, n) else at(a + n), i) for k, a, n, i in spans], "k string, opened timestamp_ntz, ended timestamp_ntz, span long")
    p = table(spark, points).withColumnsRenamed({"i": "point", "ts": "at"})
    out = temporal.interval_join(s, p, ["k"], "opened", "ended", "at", 60)
    want = sorted((i, j) for k, a, n, i in spans for q, t, j in points if k is not None and k == q and None not in (a, n, t) and a <= t < a + n)
    assert sorted((r.span, r.point) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.interval_join(s.limit(0), p, ["k"], "opened", "ended", "at", 60).isEmpty()


def test_frames(spark):
    rows = table(spark, [("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("a", 25, 4), ("b", 11, 5)])
    got = rows.select("i", F.count("*").over(temporal.last_seconds(["k"], "ts", 15)).alias("s"), F.count("*").over(temporal.last_rows(["k"], ["ts", "i"], 2)).alias("r")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (2, 3, 2), (3, 3, 2), (4, 3, 2), (5, 1, 1)]


def write_events(spark, folder, number, rows):
    df = spark.createDataFrame([(i, at(t), u, kind, 1.0, "{}") for i, t, u, kind in rows], stream.EVENTS)
    df.coalesce(1).write.parquet(f"{folder}/{number}")


def test_late_rows(spark, tmp_path):
    """A row that is late but within the delay joins its session; one beyond it is dropped and counted."""
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        s = stream.event_stream(spark, f"{folder}/*")
        return stream.to_files(stream.closed_sessions(s, "60 seconds", "100 seconds"), out)

    write_events(spark, folder, 1, [(1, 0, 7, "view"), (2, 50, 7, "view"), (3, 1000, 7, "view")])
    assert stream.dropped(run()) == 0
    write_events(spark, folder, 2, [(4, 960, 7, "view"), (5, 30, 7, "view"), (6, 5000, 8, "view")])  # the first is in time, the second is not
    assert stream.dropped(run()) == 1
    got = sorted((r.user_id, r.start, r.end, r.events) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [(7, at(0), at(110), 2), (7, at(960), at(1060), 2)]


def test_two_streams(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((rng.randrange(5000), rng.randrange(4), rng.choice(["view", "purchase", "error"])) for _ in range(400))
    rows = [(i, t, u, kind) for i, (t, u, kind) in enumerate(rows)]
    for n in range(4):
        write_events(spark, tmp_path / "in", n, rows[100 * n : 100 * n + 100])
    s = stream.event_stream(spark, f"{tmp_path}/in/*", files=1)
    query = stream.to_files(stream.followed(s, "view", "purchase", "90 seconds", "10 seconds"), str(tmp_path / "out"))
    got = sorted((r.user_id, r.first_id, r.then_id) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    want = sorted((u, i, j) for i, t, u, k in rows for j, x, v, q in rows if (k, q, u) == ("view", "purchase", v) and t <= x < t + 90)
    assert got == want and want
    kept = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert max(kept) < 200  # of 267 views and purchases: state goes as the watermark passes
