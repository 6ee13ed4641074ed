"""Cutting lineage in a way that survives the loss of executors, and work for idle cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share, from the setting spark.checkpoint.dir.

    Only in local mode, as in tests, a temporary folder is set where the session names none; on a
    cluster that raises, because a folder of one machine would not survive it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


FEW_PARTS = 64  # an input of more parts is large enough to stay where it is read


def spread(df: DataFrame) -> DataFrame:
    """The rows over more cores, where a small input has fewer parts than there are cores (one file, say).

    Results do not depend on it. Select the needed columns before; a large input is never moved.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(min(cores, FEW_PARTS)) if parts < min(cores, FEW_PARTS) else df
