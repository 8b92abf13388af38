"""Rows written out between steps, and file tests that work for every store that Spark reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Make checkpoints go to spark.checkpoint.dir or a folder set before; a local one serves only a session that runs in
    this very process. A cluster without a shared folder is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestrand-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder: what follows starts from there, whatever executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
