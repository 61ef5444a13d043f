"""Stateful streams: count windows and deduplication on `transformWithState` with typed state and time-to-live, sessions on session windows, in a store that spills to disk.

State lives in RocksDB, one store a shuffle partition, so keys need not fit in memory, and goes
to the checkpoint with each batch: a restart goes on from there.  Keys are split into
:data:`LANES` lanes where the result allows it, so a key that most rows have is no single task.

Frames of a processor name their columns only if the names are plain words, so columns have such
names inside, and their own again outside.

Count windows need the order of a key's rows.  Rows carry a number of their own (`order`), and
a batch's rows are taken in that order; rows of later batches come after those of earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LANES = 16


def use_rocks(spark: SparkSession) -> None:
    """State stores of streams that start from now on are RocksDB's, with a change log a batch and a full copy now and then."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class _CountWindows(StatefulProcessor):
    """Closes a window after `size` rows of its key; state is the open window alone, whatever the size."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "window long, n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        window, n, total = self.open.get() if self.open.exists() else (0, 0, 0.0)
        out = []
        for x in pd.concat(list(rows)).sort_values("place")["value"]:
            n, total = n + 1, total + float(x)
            if n == self.size:
                out.append((key[0], window, n, total))
                window, n, total = window + 1, 0, 0.0
        self.open.update((window, n, total))
        yield pd.DataFrame(out, columns=["name", "window", "n", "total"])

    def close(self) -> None:
        pass


def count_windows(events: DataFrame, key: str, value: str, order: str, size: int) -> DataFrame:
    """key, window, n, total: every `size` events of a key. A last part window gives nothing until it is full.

    The windows of a key follow one another, so a key is one task's; a batch of it is what is held.
    """
    if size < 1:
        raise ValueError("a window holds a row at least")
    schema = f"name {_type(events, key)}, window long, n long, total double"
    rows = events.select(F.col(key).alias("name"), F.col(value).alias("value"), F.col(order).alias("place"))
    return rows.groupBy("name").transformWithStateInPandas(_CountWindows(size), schema, "append", "None").withColumnRenamed("name", key)


def sessions(events: DataFrame, key: str, ts: str, value: str, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """key, start, end, n, total: events of a key less than `gap_ms` apart, given out when event time has passed the gap.

    Times are whole milliseconds. An event that joins two sessions makes them one. An event is dropped as late when the
    watermark is `gap_ms` or more beyond it: the session that it would be alone is over. One without a time is in no session.
    """
    # times that are exactly the gap apart are in two sessions, whichever side a window's end belongs to
    gap = f"{gap_ms * 1000 - 1} microseconds"
    at = F.date_trunc("millisecond", F.col(ts).cast("timestamp"))
    df = events.select(F.col(key).alias("name"), at.alias("at"), F.col(value).cast("double").alias("value")).withWatermark("at", late)
    by = df.groupBy("name", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("name").alias(key), F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("end"), "n", "total")


class _FirstOfKey(StatefulProcessor):
    """Passes the first row of each request on and forgets the request after `ttl` milliseconds (None: never)."""

    def __init__(self, order: str, names: list[str], ttl: int | None):
        self.order, self.names, self.ttl = order, names, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("request", T.StringType())]), "first long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order).drop_duplicates("request")
        new = [not self.seen.containsKey((r,)) for r in frame["request"]]
        fresh = frame[new]
        for request, order in zip(fresh["request"], fresh[self.order], strict=True):
            self.seen.updateValue((request,), (int(order),))
        yield fresh[self.names]

    def close(self) -> None:
        pass


def first_of_each(events: DataFrame, keys: list[str], order: str, ttl_ms: int | None = None, lanes: int = LANES) -> DataFrame:
    """The first row of each request (the values of `keys`), in order of a number; what was passed on is not passed on again.

    A request that was answered needs no second answer, also after a restart. Requests are dealt by hash into lanes, and a
    lane's state is a map on disk, so there are few groups and each holds as many requests as there are.
    """
    request = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]), 256)
    names = [f"c{i}" for i in range(len(events.columns))]
    df = events.select(*[F.col(c).alias(n) for c, n in zip(events.columns, names, strict=True)], request.alias("request"))
    df = df.withColumn("lane", F.pmod(F.xxhash64("request"), F.lit(lanes)).cast("int"))
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, events.schema, strict=True)])
    first = _FirstOfKey(names[events.columns.index(order)], names, ttl_ms)
    return df.groupBy("lane").transformWithStateInPandas(first, plain, "append", "ProcessingTime" if ttl_ms else "None").toDF(*events.columns)
