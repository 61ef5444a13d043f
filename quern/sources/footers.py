"""Schema drift by file: executors read the footers of Parquet files, no row of them, and hold each against what is expected.

A table of many files is as often wrong in one of them as in all.  Files are listed once and dealt out to tasks; a task reads
the footer of each of its files, so the work is a few kilobytes a file.  One row comes for each file and column that is there or
is expected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from quern.sources import cache

_SCHEMA = "file string, rows long, name string, expected string, found string, drift string"
#: files of a task
FILES = 64


def _drift(expected: str | None, found: str | None) -> str:
    if expected is None:
        return "extra"
    if found is None:
        return "missing"
    return "same" if expected == found else "retyped"


def _found(path: str) -> tuple[int, dict[str, str]]:
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        meta = pq.read_metadata(f)
    return meta.num_rows, {x.name: from_arrow_type(x.type).simpleString() for x in meta.schema.to_arrow_schema()}


def _compared(expected: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("file").to_pylist():
                rows, found = _found(path)
                for name in [*expected, *[n for n in found if n not in expected]]:
                    out.append((path, rows, name, expected.get(name), found.get(name), _drift(expected.get(name), found.get(name))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "rows", "name", "expected", "found", "drift"])

    return run


def drift(spark: SparkSession, path: str, expected: T.StructType) -> DataFrame:
    """file, rows, name, expected, found, drift (same, missing, extra, retyped) for each Parquet file under `path`; types are Spark's names."""
    files = [x["path"] for x in cache.fingerprint(spark, path) if x["path"].endswith(".parquet") and not any(p.startswith(("_", ".")) for p in x["path"].removeprefix(path).split("/"))]
    # file:/x is what Hadoop says, file:///x what others read
    files = [f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file://") else f for f in files]
    df = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files) // FILES))
    return df.mapInArrow(_compared({f.name: f.dataType.simpleString() for f in expected}), _SCHEMA)


def require_no_drift(spark: SparkSession, path: str, expected: T.StructType, allow: tuple[str, ...] = ()) -> None:
    """An error that names the first files whose columns are not as expected; kinds of drift in `allow` pass."""
    odd = drift(spark, path, expected).where((F.col("drift") != "same") & ~F.col("drift").isin(*allow)).orderBy("file", "name").limit(5).collect()
    if odd:
        raise ValueError("; ".join(f"{r.file}: {r.name} is {r.drift}" + (f" ({r.found} instead of {r.expected})" if r.drift == "retyped" else "") for r in odd))
