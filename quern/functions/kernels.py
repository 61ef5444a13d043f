"""Columns over arrays of numbers: log-probabilities and losses, all in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def token_logprob(logits: Column, target: Column) -> Column:
    """log softmax of a position's logits at its target; null for an ignored target or one beyond the vocabulary."""
    x = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    at = F.when((target >= 0) & (target < F.size(logits)), F.get(x, target))
    return at - (top + F.ln(total))


def softplus(z: Column) -> Column:
    """ln(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def dpo_margin(pc: Column, pr: Column, rc: Column, rr: Column) -> Column:
    """How much more than the reference the policy prefers the chosen answer."""
    return (pc - pr) - (rc - rr)


def dpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float) -> Column:
    if beta <= 0:
        raise ValueError("beta is positive")
    return softplus(-beta * dpo_margin(pc, pr, rc, rr))


def ratio(policy: Column, old: Column) -> Column:
    return F.exp(policy - old)


def clipped_objective(policy: Column, old: Column, advantage: Column, clip: float) -> Column:
    if clip <= 0:
        raise ValueError("the clip range is positive")
    r = ratio(policy, old)
    return F.least(r * advantage, F.greatest(F.least(r, F.lit(1 + clip)), F.lit(1 - clip)) * advantage)


def kl_estimate(policy: Column, reference: Column) -> Column:
    """Non-negative estimate exp(d) - d - 1 with d = reference - policy."""
    d = reference - policy
    return F.exp(d) - d - 1


def grpo_term(policy: Column, old: Column, reference: Column, advantage: Column, clip: float, beta: float) -> Column:
    """A token's loss."""
    if beta < 0:
        raise ValueError("beta is not negative")
    return -(clipped_objective(policy, old, advantage, clip) - beta * kl_estimate(policy, reference))


def masked_loss(df: DataFrame, columns: Sequence[str], mask: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, the mean of each column over tokens whose `mask` is 1, and `tokens`. A mask without tokens, or of other values, is an error."""
    m = F.col(mask).cast("double")
    by = df.groupBy(*keys).agg(*[(F.sum(F.col(c) * m) / F.sum(m)).alias(c) for c in columns], F.sum(m).alias("tokens"), F.count_if(m.isNull() | ~m.isin(0.0, 1.0)).alias("__odd"))
    fault = F.when(F.col("__odd") > 0, "a mask is 0 or 1").when(F.coalesce("tokens", F.lit(0.0)) == 0, "the mask has no tokens")
    return by.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).drop("__odd")


def require_same_length(*arrays: Column) -> Column:
    """True, or an error where arrays of a row differ in length."""
    same = [F.size(a) == F.size(arrays[0]) for a in arrays[1:]]
    return F.when(F.array_min(F.array(*same)), F.lit(True)).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("boolean"))
