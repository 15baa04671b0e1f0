"""Cutting lineage through shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Only where none is set, and only in local mode, a temporary folder is used instead.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Compute a frame once and read it back from the checkpoint folder.

    For small aggregates that several branches of a plan read. The data is on shared storage, so
    a lost executor costs a re-read, not a recomputation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
