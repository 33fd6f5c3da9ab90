"""Streams of events: sessions with late rows, and two streams joined within a time bound.

State is keyed by the columns of the grouping or join and leaves it when the watermark has passed it. Results go to files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators import temporal

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors share; a local session without it gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext._jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="parley-streams-")
    return f"{shared.rstrip('/')}/streams-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Events of the files in a folder, files of them in a micro-batch at most. Times are taken as UTC."""
    options = {"pathGlobFilter": pattern} | ({"maxFilesPerTrigger": files} if files else {})
    return spark.readStream.schema(EVENTS).options(**options).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def closed_sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of users that the watermark has passed: a row that comes later than delay after newer ones is dropped if its session is closed."""
    return temporal.sessions(stream.withWatermark("ts", delay), ["user_id"], "ts", gap, events=F.count("*"), value=F.sum("value"))


def followed(stream: DataFrame, first: str, then: str, within: str, delay: str) -> DataFrame:
    """Pairs of a first and a then event of one user, then later by less than within. Both sides' state goes as the watermark passes."""
    side = lambda kind, name: stream.filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    a, b = side(first, "first").withWatermark("first_ts", delay), side(then, "then").withWatermark("then_ts", delay)
    on = (F.col("first_user") == F.col("then_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") < F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select(F.col("first_user").alias("user_id"), "first_id", "then_id")


def to_files(df: DataFrame, folder: str) -> StreamingQuery:
    """Runs over what is there now and appends to folder/rows; run again it goes on from where it was."""
    query = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late for the query's state, over its recent progress."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
