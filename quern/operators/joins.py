"""Join-shaped operators that state their contract: counts that must agree, positions, disjointness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GRID_ROWS = 10_000


def zip_strict(left: DataFrame, right: DataFrame, on: str = "ordinal") -> DataFrame:
    """Rows of equal place side by side; a place that only one side has is an error."""
    a, b = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    both = a.join(b, on, "full")
    ok = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    fault = F.raise_error(F.concat(F.lit("only one side has place "), F.col(on).cast("string"))).cast("boolean")
    return both.where(F.when(ok, F.lit(True)).otherwise(fault)).drop("__l", "__r")


def attach(df: DataFrame, cache: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """`df` with a cache's columns; a row without them is an error."""
    out = df.join(cache.select(on, *columns, F.lit(1).alias("__known")), on, "left")
    fault = F.raise_error(F.concat(F.lit("not in the cache: "), F.col(on).cast("string"))).cast("boolean")
    return out.where(F.when(F.col("__known") == 1, F.lit(True)).otherwise(fault)).drop("__known")


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of `a` with every row of `b`: for lists of checkpoints and sources; `b` has GRID_ROWS rows at most."""
    if b.limit(GRID_ROWS + 1).count() > GRID_ROWS:
        raise ValueError(f"a grid has {GRID_ROWS} rows on its right side at most")
    return a.crossJoin(F.broadcast(b))


def disjoint(train: DataFrame, evaluation: DataFrame, text: str = "prompt") -> DataFrame:
    """Rows of `train` whose text isn't in `evaluation` (by hash of the trimmed, lower-cased text)."""
    key = F.sha2(F.lower(F.trim(F.col(text))), 256)
    known = evaluation.select(key.alias("__key")).distinct()
    return train.withColumn("__key", key).join(known, "__key", "left_anti").drop("__key")


def members(df: DataFrame, keys: DataFrame, on: str, keep: bool = True) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi" if keep else "left_anti")


def split_faults(train: DataFrame, val: DataFrame, whole: DataFrame, on: str) -> DataFrame:
    """One row: keys in both parts, keys in neither, keys from elsewhere. A split has none of each."""
    a, b, w = (x.select(on) for x in (train, val, whole))
    parts = {"in_both": a.intersect(b), "in_none": w.exceptAll(a.unionAll(b)), "from_elsewhere": a.unionAll(b).exceptAll(w)}
    return _counts(parts)


def _counts(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
