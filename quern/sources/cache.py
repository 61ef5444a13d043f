"""Fingerprinted tables: a hit reads, a miss computes, and what was asked for is part of the key."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Path, size and time of each file under `path`, as any file system that Spark reads tells them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    it, out = fs.listFiles(target, True), []
    while it.hasNext():
        f = it.next()
        out.append({"path": f.getPath().toString(), "size": f.getLen(), "mtime": f.getModificationTime()})
    return sorted(out, key=lambda x: x["path"])


def key_of(parts: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, parts: dict[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
    """The table for these parts, made on the first call. Any part that differs is another table."""
    path = f"{root.rstrip('/')}/{key_of(parts)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def row_key(*columns: str) -> Column:
    """Key of a row's request, e.g. prompt, model revision, sampling settings; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def missing(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that the cache doesn't have, each once."""
    keys = list(keys)
    return wanted.dropDuplicates(keys).join(cache.select(*keys).distinct(), keys, "left_anti")


class Bucketed:
    """A cache of rows by request key, laid out in buckets of the key, so that looking requests up moves the requests alone.

    The table is a bucketed one of the session's catalog at a place of its own, which another session finds again. A request
    is dealt to the bucket of its key and meets the bucket's files there: the cache is neither shuffled nor sorted. New rows are
    appended to the files of their buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.name = f"cache_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Requests that the cache doesn't have, each key once; a null key is never cached."""
        once = wanted.repartition(self.buckets, self.key).dropDuplicates([self.key])
        return once.hint("shuffle_hash").join(self.rows().select(self.key).hint("shuffle_hash"), self.key, "left_anti")

    def found(self, wanted: DataFrame) -> DataFrame:
        """Requests with the cached columns."""
        return wanted.repartition(self.buckets, self.key).hint("shuffle_hash").join(self.rows(), self.key)

    def append(self, rows: DataFrame) -> None:
        """One file a bucket. Keys that are there already, or null, are left out, so a repeated append adds nothing."""
        new = self.missing(rows.where(F.col(self.key).isNotNull())).select(*self.rows().columns)
        new.repartition(self.buckets, self.key).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
