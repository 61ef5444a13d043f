"""Bootstrap intervals in two phases: partial sums of all rounds in each task, then sums of these by key.

Resampling is Poisson's: in every round each row counts 0, 1, 2, ... times with the
chances of a Poisson variable of mean 1, independently of all others, so no row
has to know of another.  How often comes from two 32-bit halves of one md5 of seed and
row key, mixed with the round's number by an integer finaliser; so a row is hashed once
whatever the number of rounds, and the result depends neither on partitions nor on order
and is the same in any engine that has md5 and integers.

A task holds two vectors of `rounds` numbers for each key that it meets, and passes them
on when there are more than :data:`HELD` numbers; rows are never copied or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed multipliers of the finaliser, and the step between rounds
MIX, STEP = (0x7FEB352D, 0x846CA68B), 0x9E3779B9
CHUNK, HELD = 1 << 21, 1 << 21


def steps() -> list[int]:
    """Chances of at most 0, 1, 2, ... draws, in units of 2 ** -32, up to the last below 1."""
    out, chance, k = [], math.exp(-1), 0
    while not out or out[-1] < (1 << 32) - 1:
        out.append(int(chance * (1 << 32)))
        k += 1
        chance += math.exp(-1) / math.factorial(k)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 32 bits; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX[1])
    x ^= x >> np.uint32(16)
    return x


def weights(high: np.ndarray, low: np.ndarray, rounds: int) -> np.ndarray:
    """How often each row (two halves of its hash) is drawn in each round: rows x rounds."""
    x = mixed(low.astype(np.uint32)[:, None] + np.arange(rounds, dtype=np.uint32) * np.uint32(STEP))
    x ^= high.astype(np.uint32)[:, None]
    return np.searchsorted(np.array(steps(), np.uint32), mixed(x), side="right")


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A number for each row, equal for rows of equal keys; nulls are equal."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = batch.column(k).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _partial(keys: list[str], rounds: int, kinds: pa.Schema):
    def written(held: dict) -> pa.RecordBatch:
        names = [pa.array([k[i] for k in held], kinds.field(c).type) for i, c in enumerate(keys)]
        w, x, n, s = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([*names, pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(list(w), pa.list_(pa.int64())), pa.array(list(x), pa.list_(pa.float64()))], names=[*keys, "n", "s", "w", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CHUNK // rounds)):
                batch = whole.slice(at, max(1, CHUNK // rounds))
                high, low, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__high", "__low", "__value"))
                code = _codes(batch, keys)
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
                drawn = weights(high[order], low[order], rounds)
                w, wx = np.add.reduceat(drawn, first, axis=0), np.add.reduceat(drawn * x[order, None], first, axis=0)
                n, s = np.diff(np.append(first, len(order))), np.add.reduceat(x[order], first)
                for g, row in enumerate(order[first].tolist()):
                    key = tuple(batch.column(k)[row].as_py() for k in keys)
                    have = held.setdefault(key, [np.zeros(rounds, np.int64), np.zeros(rounds), 0, 0.0])
                    have[0] += w[g]
                    have[1] += wx[g]
                    have[2] += int(n[g])
                    have[3] += float(s[g])
                if len(held) * rounds > HELD:
                    yield written(held)
                    held = {}
        if held:
            yield written(held)

    return run


def bootstrap_ci(df: DataFrame, value: str, key: str, rounds: int = 200, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, mean, lo, hi: the 95 % interval of the mean of `value`; rows are told apart by `key`.

    Null values don't count; keys without any have no row, and no rows at all give none. lo and hi are the means at places
    floor(0.025 m) and floor(0.975 m), in order, of the m rounds that drew any row.
    """
    if rounds < 1:
        raise ValueError("there is a round at least")
    keys = list(keys)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    half = lambda k: F.conv(F.substr(digest, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*keys, half(0).alias("__high"), half(1).alias("__low"), F.col(value).cast("double").alias("__value"))
    kinds = rows.select(*keys).schema
    schema = T.StructType([*kinds.fields, *T._parse_datatype_string("n long, s double, w array<long>, x array<double>").fields])
    part = rows.mapInArrow(_partial(keys, rounds, rows.select(*keys).limit(0).toArrow().schema), schema)
    each = part.select(*keys, F.posexplode(F.arrays_zip("w", "x")).alias("round", "y"), "n", "s").groupBy(*keys, "round").agg(F.sum("y.w").alias("w"), F.sum("y.x").alias("x"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    by = each.groupBy(*keys).agg(F.max("n").alias("n"), (F.max(F.when(F.col("round") == 0, F.col("s"))) / F.max("n")).alias("mean"), F.array_sort(F.collect_list(F.when(F.col("w") > 0, F.col("x") / F.col("w")))).alias("means"))
    at = lambda share: F.get("means", F.floor(F.size("means") * share).cast("int"))
    return by.where("n > 0").select(*keys, "n", "mean", at(0.025).alias("lo"), at(0.975).alias("hi"))
