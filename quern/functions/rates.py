"""Columns for success rates, schedules and cost."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EASY, HARD = 0.8, 0.2


def success_bucket(rate: Column) -> Column:
    """easy from 0.8 on, hard up to 0.2, else ambiguous; a rate beyond 0 to 1 is an error."""
    fault = F.raise_error(F.concat(F.lit("a success rate lies between 0 and 1: "), rate.cast("string"))).cast("string")
    return F.when((rate < 0) | (rate > 1), fault).when(rate >= EASY, "easy").when(rate <= HARD, "hard").when(rate.isNotNull(), "ambiguous")


def adaptive_weight(bucket: Column) -> Column:
    return F.when(bucket == "easy", 0.25).when(bucket == "hard", 0.5).when(bucket == "ambiguous", 1.0)


def extra_samples(bucket: Column) -> Column:
    """Further samples worth drawing: only ambiguous prompts get more."""
    return F.when(bucket == "ambiguous", 12).when(bucket.isNotNull(), 0)


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Share of the peak learning rate: linear up to `warmup`, then half a cosine down to 0 at `total`."""
    if not 0 <= warmup < total:
        raise ValueError("the warm-up ends before the last step")
    down = 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / (total - warmup)))
    return F.when(step < warmup, step / warmup if warmup else F.lit(0.0)).otherwise(down)


def dollars(seconds: Column, per_hour: Column) -> Column:
    """Cost of a run; null where the rate is unknown."""
    return seconds / 3600 * per_hour


def throughput(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(0.0)


def finite(x: Column, step: Column) -> Column:
    """`x`, or an error that names the step where it is NaN or infinite."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.raise_error(F.concat(F.lit("a loss isn't finite at step "), step.cast("string"))).cast("double")).otherwise(x)
