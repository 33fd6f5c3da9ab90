"""Working copies of what a plan reads several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and kept as a checkpoint in spark.checkpoint.dir, which executors share; so a lost executor loses
    nothing. Spark deletes it once nothing refers to it, where spark.cleaner.referenceTracking.cleanCheckpoints is set. A local
    session without that folder gets a temporary one; a cluster has to name it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context._jsc.isLocal():
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="parley-working-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
