"""Exact order statistics by digit histograms: the value at a place in order, without sorting and without ranking all values.

Numbers become 64-bit integers of the same order (floating-point numbers by their bits).  Equal numbers are counted first.
Then the wanted value is found from its highest digit on: a histogram of :data:`DIGIT` bits says in which bin the place lies and
how many values are before it, and the next histogram counts within that bin.  Every histogram has at most 2 ** DIGIT bins a
place and key, whatever the number of different values, so that is the largest window; six of them pin a 64-bit number down,
three a 32-bit one.  The whole is one lazy plan over the counts, which are shuffled once.

NaN is the largest number, -0.0 is 0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT = 11
_FLOATS = (T.FloatType, T.DoubleType)
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64, T.FloatType: 64, T.DoubleType: 64}


def to_order(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def from_order(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, i ^ np.int64((1 << 63) - 1), i).view(np.float64)


def _mapped(columns: Sequence[str], f: Callable[[np.ndarray], np.ndarray], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in columns:
                x = batch.column(c)
                made = pa.array(f(x.fill_null(0).to_numpy(zero_copy_only=False)), kind, mask=x.is_null().to_numpy(zero_copy_only=False))
                batch = batch.set_column(batch.schema.get_field_index(c), c, made)
            yield batch

    return run


def _retyped(df: DataFrame, columns: Sequence[str], kind: T.DataType, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    schema = T.StructType([T.StructField(x.name, kind if x.name in columns else x.dataType) for x in df.schema])
    return df.mapInArrow(_mapped(columns, f, pa.int64() if isinstance(kind, T.LongType) else pa.float64()), schema)


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def at_places(df: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], keys: Sequence[str] = ()) -> DataFrame:
    """keys, count, and for each name the value at `places[name](count)`, a place from 0, in order; null where there is no such place.

    Null values don't count. Keys without values have no row.
    """
    keys, kind = list(keys), df.schema[value].dataType
    if type(kind) not in _BITS:
        raise ValueError(f"{value} is no number of at most 64 bits")
    floats = isinstance(kind, _FLOATS)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double" if floats else "long").alias("v"))
    by = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    if floats:
        by = _retyped(by, ["v"], T.LongType(), to_order)
    totals = by.groupBy(*keys).agg(F.sum("c").alias("count"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("count")).cast("long").alias("left")) for n, f in places.items()]))
    found = totals.where(F.col("count") > 0).select(*keys, wanted.alias("x")).select(*keys, "x.*", F.lit(None).cast("long").alias("prefix"))
    # digits from the top; the top one has the sign
    width = _BITS[type(kind)]
    for level, shift in enumerate(reversed(range(0, width, DIGIT))):
        digit = F.shiftright("v", shift)
        inside = _same(keys, "b", "f")
        if level:
            inside = inside & (F.shiftright("b.v", shift + DIGIT) == F.col("f.prefix"))
        few = found if keys else F.broadcast(found)  # without keys, a row for each name
        bins = by.alias("b").join(few.alias("f"), inside).select(*[F.col(f"b.{k}") for k in keys], "name", "left", digit.alias("digit"), "c")
        bins = bins.groupBy(*keys, "name", "left", "digit").agg(F.sum("c").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("digit"))
        bins = bins.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        found = bins.select(*keys, "name", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("digit").alias("prefix"))
    out = totals.alias("b").join((found if keys else F.broadcast(found)).alias("f"), _same(keys, "b", "f"), "left")
    out = out.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], "count").agg(*[F.max(F.when(F.col("name") == n, F.col("prefix"))).alias(n) for n in places]).where(F.col("count") > 0)
    if floats:
        out = _retyped(out, list(places), T.DoubleType(), from_order)
    return out.withColumns({n: F.col(n).cast(kind) for n in places})
