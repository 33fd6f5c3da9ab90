"""Conversations as they arrive: a file stream of turns, measured batch by batch. An extra beside the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.streaming.events import work_folder

TURNS = "conv_id long, turn long, role string, text string"


def table_files(sf_dir: str, table: str) -> str:
    """A path of a table's files, be the table one file or a folder of files. The pattern in it has streams take it as batch readers do."""
    return f"{sf_dir.rstrip('/')}/{table}.parque[t]"


def turn_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(TURNS).option("pathGlobFilter", pattern).parquet(folder)


def rates_by_role(stream: DataFrame) -> DataFrame:
    """Running turns and words of each role: state is one row a role."""
    words = F.size(F.array_remove(F.split("text", r"(?U)\s+"), ""))
    return stream.groupBy("role").agg(F.count("*").alias("turns"), F.sum(words).cast("long").alias("words"))


def to_completion(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs what is there now and returns the result table. State is kept where executors share it."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{work_folder(df.sparkSession)}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """write(batch, number) for every micro-batch; a batch that is run again comes with the same number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
