"""Lineage cuts in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is configured, a local master (tests) gets a temporary one; a cluster
    must name a folder that its executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not where and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="veriframe-checkpoint-"))
    return (where or context.getCheckpointDir()).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
