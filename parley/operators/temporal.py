"""Events in time: as-of and interval joins, sessions, and moving frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MICROS = 1_000_000


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time as it reads, with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: int, order: str, prefix: str = "last_", strict: bool = False) -> DataFrame:
    """left with right's columns, prefixed, of the last row of right at or (strict) before its time, tolerance seconds ago at most; null without one.

    Of rows of right at one time that with the greatest order counts. Rows with a null time or key find nothing, and are found by nothing; repeated rows stay. Both sides are put under each other in
    buckets of by and time, a bucket as long as the tolerance, so that what a row looks for stands in its bucket or was the last of the one
    before, which is carried over as one row a bucket. So a key with many rows is as many tasks as it has buckets, and no pair is formed.
    """
    bucket = F.floor(micros(F.col(at)) / (tolerance * MICROS))
    payload = F.struct(*[F.col(c) for c in right.columns])
    sound = F.lit(True)
    for c in [*by, at]:
        sound = sound & F.col(c).isNotNull()
    own = right.filter(sound).select(*by, bucket.alias("__bucket"), F.col(at).alias("__at"), F.lit(2 if strict else 0).alias("__side"), F.col(order).alias("__order"), payload.alias("__found"))
    carried = own.groupBy(*by, "__bucket").agg(F.max_by(F.struct("__at", "__side", "__order", "__found"), F.struct("__at", "__order")).alias("c"))
    carried = carried.select(*by, (F.col("__bucket") + 1).alias("__bucket"), "c.*")
    row = F.struct(*[F.col(c) for c in left.columns])
    asking = left.select(*by, bucket.alias("__bucket"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[order].dataType).alias("__order"), row.alias("__row"))
    every = own.unionByName(carried).unionByName(asking, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__bucket").orderBy("__at", "__side", F.col("__order").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = every.withColumn("__seen", F.last("__found", ignorenulls=True).over(w)).filter("__row IS NOT NULL")
    age = micros(F.col("__row")[at]) - micros(F.col("__seen")[at])
    near = F.when(age <= tolerance * MICROS, F.col("__seen"))
    return seen.select("__row.*", *[near[c].alias(prefix + c) for c in right.columns if c not in by])


def interval_join(spans: DataFrame, points: DataFrame, by: list[str], start: str, end: str, at: str, bin: int) -> DataFrame:
    """Pairs of spans and points with start <= at < end and equal by; columns of both, so their other names should differ.

    Spans and points meet by time bins. A span is put in bins of bin seconds times the power of two that is its length or more, so it is in
    two bins at most, however long; a point is in one bin of each such length that spans have, 63 at most. So a pair meets once, by an
    equality, and the exact condition is checked on what meets. Null or empty spans hold nothing. Which lengths there are is asked for when the
    join is planned.
    """
    length = F.greatest((micros(F.col(end)) - micros(F.col(start))) / F.lit(bin * MICROS), F.lit(1.0))
    own = spans.filter(F.col(start) < F.col(end)).withColumn("__level", F.ceil(F.log2(length)).cast("int"))
    width = lambda: F.lit(bin * MICROS) * F.pow(F.lit(2.0), F.col("__level"))
    bins = lambda c: F.floor(micros(F.col(c)) / width())
    own = own.withColumn("__bin", F.explode(F.sequence(bins(start), bins(end))))
    levels = sorted(own.select("__level").distinct().toPandas()["__level"].tolist())  # a number for each power of two at most
    there = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", bins(at))
    met = own.join(there, [*by, "__level", "__bin"])
    return met.filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__level", "__bin")


def sessions(rows: DataFrame, by: list[str], at: str, gap: str, **aggregates: Column) -> DataFrame:
    """by, start, end and aggregates of each run of rows that are gap apart at most; the end is gap after the last. In batch and on a stream with a watermark alike."""
    return rows.groupBy(*by, F.session_window(at, gap).alias("__s")).agg(*[c.alias(n) for n, c in aggregates.items()]).select(*by, F.col("__s.start").alias("start"), F.col("__s.end").alias("end"), *aggregates)


def last_rows(by: list[str], order: list[str], rows: int):
    """The frame of a row and the rows before it, so many together."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)


def last_seconds(by: list[str], at: str, seconds: int):
    """The frame of all rows of at most so many seconds before, equal times included."""
    return Window.partitionBy(*by).orderBy(micros(F.col(at))).rangeBetween(-seconds * MICROS, 0)
