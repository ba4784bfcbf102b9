"""Versions of a table or document in one folder, of which readers see the last whole one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.report import upsert_history

_POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), at


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last whole version, if there is one."""
    jvm, fs, at = _files(spark, f"{path}/{_POINTER}")
    if not fs.exists(at):
        return None
    return f"{path}/{spark.read.text(f'{path}/{_POINTER}').first()['value']}"


def publish(rows: DataFrame, path: str) -> str:
    """Writes a new version below ``path`` and then makes it the current one.

    The version is whole before the pointer moves; the pointer is one small file that a
    rename replaces. Whoever fails in between leaves the version before in place. One
    writer at a time.
    """
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    jvm, fs, made = _files(spark, f"{path}/.{version}")
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(made, jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}"), options)
    return f"{path}/{version}"


def restore(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the last whole version; nothing if there is none."""
    at = current(spark, path)
    return spark.read.parquet(at) if at else None


def record(spark: SparkSession, path: str, epoch: int, metrics: DataFrame) -> DataFrame:
    """Adds (metric, value) of an epoch to the history below ``path``, in place of what that epoch had; returns the whole history."""
    before = restore(spark, path)
    new = metrics.where("value IS NOT NULL").select(F.lit(epoch).cast("long").alias("epoch"), F.lit(1).cast("long").alias("seq"), "metric", F.col("value").cast("double").alias("value"))
    # An epoch that reports nothing still replaces its record.
    mark = spark.createDataFrame([(epoch, 1, None, None)], "epoch LONG, seq LONG, metric STRING, value DOUBLE")
    new = new.unionByName(mark)
    old = before.withColumn("seq", F.lit(0).cast("long")) if before is not None else new.where("false")
    publish(upsert_history(old.select("epoch", "seq", "metric", "value"), new), path)
    return restore(spark, path)
