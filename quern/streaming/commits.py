"""A ledger that takes each batch exactly once: a batch is a folder under its number, and counts when its manifest is there.

`append` writes the rows of batch n to `batch=n`, replacing what an attempt that died has left, and then the manifest, which
is one small file put in place by a rename.  A batch that has a manifest is not written again: a stream that repeats its last
batch after a restart changes nothing.  Readers see the batches that have a manifest and no others, so half a batch is never
seen, and nothing that is there is ever rewritten.

Rows that replace earlier ones (a window's new total) are further versions of a key; `latest` gives the last of each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFESTS = "_manifests"
#: batches that are listed as folders; of more, all folders are read and batches without a manifest left out by a join
LISTED = 1000


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that count, in order."""
    fs, folder = _path(spark, f"{root}/{_MANIFESTS}")
    if not fs.exists(folder):
        return []
    return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, root: str, batch: int) -> dict[str, Any]:
    """What was said of a batch when it was committed."""
    return json.loads(spark.read.text(f"{root}/{_MANIFESTS}/{batch}.json", wholetext=True).first().value)


def _commit(spark: SparkSession, root: str, batch: int, facts: dict[str, Any]) -> None:
    fs, target = _path(spark, f"{root}/{_MANIFESTS}/{batch}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_MANIFESTS}/_{batch}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)
        if not fs.exists(target):
            raise RuntimeError(f"batch {batch} could not be committed")


def append(df: DataFrame, root: str, batch: int) -> bool:
    """Takes `df` as batch number `batch`; False, and nothing done, if that batch counts already."""
    spark = df.sparkSession
    fs, done = _path(spark, f"{root}/{_MANIFESTS}/{batch}.json")
    if fs.exists(done):
        return False
    path = f"{root}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    _commit(spark, root, batch, {"batch": batch, "rows": spark.read.schema(df.schema).parquet(path).count(), "columns": df.columns})
    return True


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches that count, with `batch`."""
    batches = committed(spark, root)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not batches:
        return spark.createDataFrame([], whole)
    if len(batches) <= LISTED:
        return spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/batch={b}" for b in batches])
    known = spark.createDataFrame([(b,) for b in batches], "batch long")
    return spark.read.schema(whole).parquet(root).join(known, "batch", "left_semi")


def latest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last batch for each of `keys`."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")


def sink(root: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`."""

    def take(df: DataFrame, batch: int) -> None:
        append(df, root, batch)

    return take
