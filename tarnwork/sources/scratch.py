"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one stands in for it in local mode only, since executors elsewhere could not read it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (given or f"file:///tmp/tarnwork-scratch-{os.getuid()}").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for inputs that are used more than once."""
    path = f"{folder(df.sparkSession)}/tarnwork-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, for values that a Parquet file would not give back as they were: a VARIANT's 2 beside a 2.5 becomes 2.0 there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
