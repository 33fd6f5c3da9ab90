"""dealt_join: the plain join's rows, and hot keys in several tasks."""

import pytest
from pyspark.sql import functions as F

from parley.llm import spread


@pytest.mark.parametrize("hot", [10, 1000])
def test_same_as_join(spark, monkeypatch, hot):
    monkeypatch.setattr(spread, "HOT_ROWS", hot)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    rows = rows.union(spark.createDataFrame([(None, 5000), (99, 5001)], "k long, id long"))
    table = spark.createDataFrame([(i, f"v{i}") for i in range(50)] + [(1000, "no row")], "k long, v string")
    counts = rows.groupBy("k").agg(F.count("*").alias("held"))
    got = spread.dealt_join(rows, table, "k", counts, F.col("id"))
    assert got.columns == ["k", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
    assert spread.dealt_join(rows.limit(0), table, "k", counts.limit(0), F.col("id")).count() == 0


def test_hot_key_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select(F.lit(1).alias("k"), "id")
        counts = rows.groupBy("k").agg(F.count("*").alias("held"))
        out = spread.dealt_join(rows, spark.createDataFrame([(1, "x")], "k int, v string"), "k", counts, F.col("id"))
        by = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in by) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
