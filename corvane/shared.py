"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder becomes the
    checkpoint folder; on a cluster without the setting this is an error,
    since executors would not see the driver's folder.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        given = tempfile.mkdtemp(prefix="corvane-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
