"""A global order without a global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.lineage import cut

_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, order: list[Column], rank: str, total: str) -> DataFrame:
    """df with its rows' places (from 0) in the given order, and the number of rows.

    Rows are range partitioned and sorted within partitions. One checkpoint fixes which partition and place
    each row got, so counting and numbering see the same rows even if an executor is lost between them.
    The only thing that is gathered is one count a partition. The order should tell all rows apart, else a
    run of equal rows stays in one partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    )
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(every).alias(total))
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn(rank, F.col("__start") + F.col("__place"))
        .drop("__part", "__place", "__start")
    )
