"""Event-time windows over a ledger as a stream, and ways to run a stream over all that is there (extensions: the rules are those of the batch reports)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str = "ts", value: str = "value", window: str = "1 day", late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window start, keys, n, total: tumbling windows in event time; a window closes when `late` has passed beyond it."""
    df = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    by = df.groupBy(F.window("__ts", window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("start"), *keys, "n", "total")


def _finish(query: StreamingQuery) -> int:
    """Waits for all that is there; rows that were dropped as too late."""
    query.awaitTermination()
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Works off all that is there and stops; a restart goes on from the checkpoint. Returns how many rows were too late."""
    return _finish(df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_upsert(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> int:
    """Hands each batch to `sink(frame, batch number)`; a batch that is repeated has the same number."""
    return _finish(df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
