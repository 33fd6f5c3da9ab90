"""Writers: CSV with the union of columns, JSON records, wide summaries, TSV per conversation, resumable output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as tx


def write_csv(frames: DataFrame | list[DataFrame], path: str) -> bool:
    """One CSV table with the union of the frames' columns in first-seen order, missing values empty. Without
    rows nothing is written; says whether something was."""
    frames = frames if isinstance(frames, list) else [frames]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def wide_summary(summary: DataFrame) -> DataFrame:
    """condition and n first, then the statistics in their order."""
    return summary.select("condition", "n", *[c for c in summary.columns if c not in ("condition", "n")])


def tsv_rows(turns: DataFrame, strict: bool = True, min_turns: int = 0) -> DataFrame:
    """conv_id, turn_index, participant, content: blank turns left out, then conversations below min_turns."""
    rows = turns.select("conv_id", "turn_index", F.col("speaker").alias("participant"), tx.tsv_safe(F.col("text"), strict).alias("content"))
    rows = rows.filter(F.trim("content") != "")
    if not min_turns:
        return rows
    enough = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_turns)
    return rows.join(enough.select("conv_id"), "conv_id", "left_semi")


def write_tsv(rows: DataFrame, path: str, folders: bool = True) -> None:
    """Turns in order, participant and content: one folder a conversation, as the alignment package wants them. Without
    folders one table, with conv_id as its first column: millions of conversations are too many files for a file system."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_index").select("conv_id", "participant", "content")
    out = ordered.write.mode("overwrite").option("sep", "\t").option("header", True)
    (out.partitionBy("conv_id") if folders else out).csv(path)


def write_summary(summary: DataFrame, path: str) -> bool:
    """A wide summary as CSV."""
    return write_csv(wide_summary(summary), path)


def write_new(records: DataFrame, path: str, key: str = "conversation_no") -> None:
    """Appends the records whose key isn't in the output yet."""
    spark = records.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if there:
        done = spark.read.json(path).select(F.col(key).cast(records.schema[key].dataType).alias(key))
        records = records.join(done, key, "left_anti")
    records.write.mode("append").json(path)
