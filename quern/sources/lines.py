"""Numbered lines of text files that tasks read in blocks, in one pass that counts and one that reads.

Spark cuts large files into blocks, and a block belongs to one task.  The first pass
counts the lines of each block, which also tells how many of them are blank; the counts,
one row a block, are written, so both what precedes a block and whether there is anything
at all come from them.  The second pass numbers the lines of a block as they come and adds
what precedes it.  Nothing rests on two executions numbering their rows alike; blocks are
matched by file, start and length, and where the second pass cuts files otherwise than the
first did, that is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import answers
from quern.sources import shared

#: blocks whose counts are broadcast; of more, lines are joined with them
MOST_BLOCKS = 200_000
_BLOCK = ("file", "begin", "size")
_SCHEMA = "file string, begin long, size long, inner long, value string"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_path", "file_block_start", "file_block_length"), _BLOCK, strict=True)]
    return spark.read.option("lineSep", "\n").text(path).select("value", *where)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each line in its block; a task reads one block after another."""
    last, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in _BLOCK]
        new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        starts = np.flatnonzero(new)
        inner = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
        if tuple(batch.column(c)[0].as_py() for c in _BLOCK) == last:
            inner[: starts[1] if len(starts) > 1 else batch.num_rows] += done
        last, done = tuple(batch.column(c)[-1].as_py() for c in _BLOCK), int(inner[-1]) + 1
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _BLOCK], pa.array(inner), batch.column("value")], names=[*_BLOCK, "inner", "value"])


def counted(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, size, n, filled, before: lines of each block, those that aren't blank, and lines of its file before it."""
    filled = F.count_if(F.length(answers.strip(F.col("value"))) > 0)
    blocks = shared.written(_scan(spark, path).groupBy(*_BLOCK).agg(F.count("*").alias("n"), filled.alias("filled")), "blocks")
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))


def read(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """line (0-based, of the file, blank ones counted), value without a carriage return at its end."""
    blocks = counted(spark, path) if blocks is None else blocks
    blocks = F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks
    rows = _scan(spark, path).select(*_BLOCK, "value").mapInArrow(_numbered, _SCHEMA)
    each = rows.join(blocks, list(_BLOCK), "left")
    moved = F.raise_error(F.concat(F.lit("a block of the file was cut otherwise when its lines were counted: "), F.col("file"))).cast("boolean")
    each = each.where(F.when(F.col("inner") < F.col("n"), F.lit(True)).otherwise(moved))
    return each.select((F.col("inner") + F.col("before")).alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def read_filled(spark: SparkSession, path: str) -> DataFrame:
    """`read` without blank lines; a path without any others is an error."""
    blocks = counted(spark, path)
    if not (blocks.agg(F.sum("filled")).first()[0] or 0):
        raise ValueError(f"{path} has no rows")
    return read(spark, path, blocks).where(F.length(answers.strip(F.col("value"))) > 0)


def objects(lines: DataFrame, value: str = "value") -> Column:
    """True for each line that is a JSON object; any other is an error that names its number, from 1."""
    is_object = answers.strip(F.col(value)).startswith("{") & F.expr(f"try_parse_json({value})").isNotNull()
    return F.when(is_object, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no JSON object in line "), (F.col("line") + 1).cast("string"))).cast("boolean"))
