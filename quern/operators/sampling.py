"""Exact, reproducible samples, splits and shards.

Order comes from md5 of the seed and the row's key, so it depends on neither
partitions nor input order, and is the same in any engine that has md5.  Every
selection ranks inside a group or takes a top-k, both of which cut rows before
they are shuffled.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import readers, shared


def hash_order(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows in hash order; fewer rows than that are an error."""
    if n < 1:
        raise ValueError("n is at least 1")
    if (have := df.limit(n).count()) < n:
        raise ValueError(f"{have} rows are fewer than {n}")
    return df.orderBy(hash_order(seed, key), key).limit(n)


def balanced_targets(n: int, sources: Sequence[str]) -> dict[str, int]:
    """n shared out: all get the whole part, the first ones one more."""
    whole, rest = divmod(n, len(sources))
    return {s: whole + (i < rest) for i, s in enumerate(sources)}


def balanced_sample(df: DataFrame, n: int, sources: Sequence[str], key: str, source: str = "source", seed: int = 42) -> DataFrame:
    """n rows, shared out over `sources`, in a common hash order; a source with too few rows is an error."""
    targets = balanced_targets(n, sources)
    have = {r[source]: r["n"] for r in df.where(F.col(source).isin(*sources)).groupBy(source).agg(F.count("*").alias("n")).collect()}
    for s, want in targets.items():
        if have.get(s, 0) < want:
            raise ValueError(f"{s} has {have.get(s, 0)} rows, {want} are wanted")
    want = F.create_map(*[x for s, t in targets.items() for x in (F.lit(s), F.lit(t))])
    order = Window.partitionBy(source).orderBy(hash_order(seed, source, key), key)
    most = max(targets.values(), default=0)
    ranked = df.where(F.col(source).isin(*sources)).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
    return ranked.where(F.col("__rank") <= want[F.col(source)]).drop("__rank").orderBy(hash_order(seed, key), key)


def stratified_split(df: DataFrame, pct: float, key: str, source: str = "source", seed: int = 42) -> DataFrame:
    """`df` with `is_val`: per source round(n * pct / 100) rows, half to even, but at least one; none if pct is 0. Keys are unique in a source."""
    if not 0 <= pct <= 100:
        raise ValueError("pct lies between 0 and 100")
    if pct == 0:
        return df.withColumn("is_val", F.lit(False))
    # rows are counted by source and first digits of their hash; the digits where a source's share ends, and among the rows that
    # have these the last one that belongs to it, are found on these counts and few rows, and no source is sorted as a whole
    df = df.withColumns({"__hash": hash_order(seed, source, key)}).withColumn("__range", F.substring("__hash", 1, 4))
    group = Window.partitionBy(source).orderBy("__range")
    counts = df.groupBy(source, "__range").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(group))
    size = F.greatest(F.bround(F.sum("__n").over(Window.partitionBy(source)) * F.lit(pct / 100.0)), F.lit(1.0)).cast("long")
    ends = counts.withColumn("__size", size).where((F.col("__upto") >= F.col("__size")) & (F.col("__upto") - F.col("__n") < F.col("__size")))
    ends = ends.select(F.col(source).alias("__source"), F.col("__range").alias("__end"), (F.col("__size") - F.col("__upto") + F.col("__n")).alias("__left"))
    ends = _few(shared.written(ends, "ends"))
    last = df.select(source, "__hash", "__range", key).join(ends, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__end")))
    place = F.row_number().over(Window.partitionBy("__source").orderBy("__hash", key))
    last = last.withColumn("__place", place).where(F.col("__place") == F.col("__left")).select("__source", F.col("__hash").alias("__last"), F.col(key).alias("__key"))
    out = df.join(_few(shared.written(last, "last")), F.col(source).eqNullSafe(F.col("__source")))
    within = (F.col("__hash") < F.col("__last")) | (F.col("__hash") == F.col("__last")) & (F.col(key) <= F.col("__key"))
    return out.withColumn("is_val", within).drop("__hash", "__range", "__source", "__last", "__key")


#: sources whose ends are broadcast; of more, rows are joined with them
MOST_SOURCES = 100_000


def _few(written: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small; its count is in its files' footers."""
    return F.broadcast(written) if written.count() <= MOST_SOURCES else written


def shard(df: DataFrame, rank: int, world: int, ordinal: str) -> DataFrame:
    if not 0 <= rank < world:
        raise ValueError("rank lies below world")
    return df.where(F.pmod(F.col(ordinal), F.lit(world)) == rank)


def batch_number(ordinal: str, size: int) -> Column:
    return F.floor(F.col(ordinal) / size).cast("long")


def head(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def at(df: DataFrame, i: int, ordinal: str) -> DataFrame:
    return df.where(F.col(ordinal) == i)


def epoch_order(df: DataFrame, epoch: int, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order of their own for each epoch."""
    return df.orderBy(hash_order(f"{seed}:{epoch}", key), key)


def epochs(df: DataFrame, n: int) -> DataFrame:
    """`df` n times over, `epoch` counting from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("epoch"))


def epoch_places(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """`df` n times over, with `epoch` and the row's `place` in that epoch's `epoch_order`, both from 0. Keys are unique.

    Rows are dealt out by the first digits of their hash, which are the first in the order too; the rows of the ranges before
    shift a range's places. Only a count for each range (at most 4096 an epoch) is brought together, and joined as its size demands.
    """
    df = epochs(df, n)
    df = df.withColumn("__hash", hash_order(seed, "epoch", key)).withColumn("__range", F.substring("__hash", 1, 3))
    before = Window.partitionBy("epoch").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = df.groupBy("epoch", "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    within = F.row_number().over(Window.partitionBy("epoch", "__range").orderBy("__hash", key)) - 1
    out = df.withColumn("__in", within.cast("long")).join(shifts, ["epoch", "__range"])
    return out.withColumn("place", F.col("__in") + F.col("__before")).drop("__hash", "__range", "__in", "__before")


def retained(df: DataFrame, last: int, path: str = "path", best: str | None = None) -> DataFrame:
    """Checkpoints to keep: the `last` highest steps and the best one. Names other than `step-N` are left alone (kept)."""
    step = F.regexp_extract(F.col(path), r"^step-(\d+)\z", 1)
    df = df.withColumn("__step", F.when(step != "", step.cast("long")))
    newest = df.where(F.col("__step").isNotNull()).select(F.col("__step").alias("__kept")).distinct().orderBy(F.desc("__kept")).limit(last)
    kept = df.join(F.broadcast(newest), F.col("__step") == F.col("__kept"), "left")  # `newest` has `last` rows at most
    wanted = F.col("__kept").isNotNull() | F.col("__step").isNull()
    if best is not None:
        wanted = wanted | (F.col(path) == best)
    return kept.where(wanted).drop("__step", "__kept")


def latest(df: DataFrame, path: str = "path") -> DataFrame:
    """The checkpoint of the highest step."""
    step = F.regexp_extract(F.col(path), r"^step-(\d+)\z", 1)
    return df.where(step != "").agg(F.max_by(F.col(path), step.cast("long")).alias(path))


#: places that are sent on together
PLACES = 100_000


def _shuffled(seed: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, name, n in frame[["number", "name", "n"]].itertuples(index=False):
                order = list(range(n))
                random.Random(f"{seed}:{name}").shuffle(order)
                for at in range(0, n, PLACES):
                    part = order[at : at + PLACES]
                    yield pd.DataFrame({"number": number, "position": part, "place": range(at, at + len(part))})

    return run


def python_shuffle(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """`df` with `place` in the order that Python's random.Random(f"{seed}:{group}") shuffles each group to, sorted by key before.

    Python's generator goes through a group's positions one after another, so one task makes the order of a group, as numbers;
    the rows of a group are never brought together. They are numbered by ranges, and meet their places on group and position.
    """
    rows = readers.with_ordinal(df, group, key)
    by = shared.written(rows.groupBy(group).agg(F.count("*").alias("n"), F.min("ordinal").alias("number")), "groups")
    name = F.coalesce(F.col(group).cast("string"), F.lit("None"))
    orders = by.select("number", name.alias("name"), "n").repartition("number").mapInPandas(_shuffled(seed), "number long, position long, place long")
    first = by.select(F.col(group).alias("__group"), "number")
    first = F.broadcast(first) if by.count() <= MOST_SOURCES else first
    placed = rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn("position", F.col("ordinal") - F.col("number"))
    return placed.join(orders, ["number", "position"]).select(*df.columns, "place")


def split_sizes(n: int, pct: float) -> int:
    """Validation rows of a source of n rows, as `stratified_split` has them."""
    if pct == 0 or n == 0:
        return 0
    whole, part = math.floor(n * pct / 100), n * pct / 100 - math.floor(n * pct / 100)
    return max(1, whole + (part > 0.5 or part == 0.5 and whole % 2 == 1))
