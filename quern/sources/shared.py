"""Folders that the driver and all executors share, for what has to be written between two steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share.

    The setting belongs to the cluster. Only where it is unset and all runs in one process (local tests), a temporary folder of
    this machine is put there until the process ends; elsewhere other executors could not read it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new shared folder and read back: what follows neither repeats its work nor depends on it coming out alike twice."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
