"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset, as in tests on one machine, a temporary folder."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="caseweave-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
