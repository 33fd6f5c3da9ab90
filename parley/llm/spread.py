"""Joins of many rows with a table of one row a key, where some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than one in HOT_KEYS of all, is dealt to several tasks. So there are fewer than
#: HOT_KEYS such keys at any size, which is what is sent to all executors: two numbers each.
HOT_ROWS, HOT_KEYS = 2000, 100_000


def dealt_join(rows: DataFrame, table: DataFrame, on: str, counts: DataFrame, by: Column, hashed: bool = False) -> DataFrame:
    """The inner join of rows with table, which has one row for each value of on.

    counts (on, held) says how many rows have each value; it is read several times, so it should be a working copy. The
    rows of a hot value are dealt by a hash of by, and its row of the table goes to each of their tasks. Without hot
    values this is the plain join. hashed: a task's share of the table is much smaller than that of the rows, and is held as a
    hash table, so that the rows needn't be sorted.
    """
    told = lambda df: df.hint("shuffle_hash") if hashed else df
    total, largest = counts.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.max("held"), F.lit(0))).first()
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    if largest <= most:
        return rows.join(told(table), on)
    hot = F.broadcast(counts.filter(F.col("held") > most).select(on, F.ceil(F.col("held") / most).cast("int").alias("__parts")))
    left = rows.join(hot, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), "__parts"), F.lit(0)).cast("int")).drop("__parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    right = table.join(hot, on, "left").withColumn("__part", every).drop("__parts")
    return left.join(told(right), [on, "__part"]).drop("__part")
