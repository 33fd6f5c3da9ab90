"""Cutting lineage for plans that are made in rounds."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Has checkpoints go to spark.checkpoint.dir. Where that is unset a local session, whose only machine this is, gets a
    temporary folder; a cluster has to name a folder that its executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context._jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parley-checkpoints-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared checkpoint folder.

    A checkpoint on its own still carries the size and the constraints that were estimated for its plan.
    Over rounds of joins the estimated size becomes a number of thousands of digits, and planning takes
    longer than running, so the kept rows are given a plan without estimates.
    """
    ensure_folder(df.sparkSession)
    done = df.checkpoint()
    session = done.sparkSession
    rows = session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return type(done)(rows, session)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nothing refers to any more, and their checkpoints too where the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints; without that they stay in the folder until it is emptied.

    Spark removes files when the driver's collector finds them unreachable, which on a large heap may be
    after the disks are full; long operators ask for it between their phases.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Arrow batches hold fewer rows than by default: texts are long, and a batch is held by the JVM, outside its
    heap and for good, as well as by the Python worker. This holds for the whole session from then on, as a plan reads
    the setting only when it runs; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
