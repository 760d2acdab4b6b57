"""Cutting lineage where a small result feeds many steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Compute a result once and cut its lineage.

    Steps after it plan against a scan and not against the whole history of
    the result, which keeps their planning short too.  The checkpoint goes to
    the directory in spark.checkpoint.dir, which all executors share, so it
    outlives any of them.  Where that is unset, a local session (a test) gets a
    directory of its own, since all its tasks run on this machine; on a
    cluster the result is persisted, and Spark computes lost parts again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith(("local[", "local-cluster[")) and context.master != "local":
            return df.persist()
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tablelens-"))
    return df.checkpoint()
