"""Record schema, validation with reasons, and guards.

A record that fails keeps a `reject_reason`; the first rule that fails names it.
Policies: `skip` counts rejects by reason, `fail` raises on the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import answers

SOURCES = ("gsm8k", "math", "finchain")
REQUIRED = ("id", "source", "prompt", "response", "final_answer")
OPTIONAL = ("category", "domain", "topic", "subtopic")
EXAMPLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in REQUIRED] + [T.StructField("difficulty", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in OPTIONAL]
)


def first_present(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.length(answers.strip(c.cast("string"))) > 0, c.cast("string")) for c in columns])


def truthy(c: Column) -> Column:
    """The text of a value, null where it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def reason_of(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds (rules state faults), null if none does."""
    out = F.lit(None).cast("string")
    for name, fault in reversed(rules):
        out = F.when(F.coalesce(fault, F.lit(False)), name).otherwise(out)
    return out


def example_faults(sources: Sequence[str] = SOURCES) -> list[tuple[str, Column]]:
    empty = [(f"{c}_empty", F.col(c).isNull() | (F.length(c) < 1)) for c in REQUIRED]
    return [*empty, ("source_unknown", ~F.col("source").isin(*sources)), ("difficulty_range", ~F.col("difficulty").between(1, 5))]


def validate(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """`df` with `reject_reason`."""
    return df.withColumn("reject_reason", reason_of(example_faults(sources)))


def accepted(df: DataFrame, policy: str = "skip") -> DataFrame:
    """Rows without a reject_reason. Under `fail` a rejected row raises when it is reached."""
    if policy == "fail":
        ok = F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rejected: "), "reject_reason")).cast("boolean"))
        return df.where(ok).drop("reject_reason")
    if policy != "skip":
        raise ValueError(f"no such policy: {policy}")
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(df: DataFrame) -> DataFrame:
    """reason, n, share of all rows in per cent."""
    total = df.agg(F.count("*").alias("total"))
    by = df.where(F.col("reject_reason").isNotNull()).groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(total)).select("reason", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def write_accepted(df: DataFrame, path: str, reasons: Sequence[str], what: str = "rows") -> dict[str, int]:
    """Writes the rows of `df` without a reject_reason, and counts in the same pass: `accepted`, and each of `reasons`.

    The counts are observed metrics of the write, which Spark takes from the task attempts that succeed, so retries count
    once. A reason that is not listed is counted as `other`. No accepted row is an error, and what was written goes again.
    """
    seen = Observation(f"accepted-{uuid.uuid4().hex}")
    why = F.col("reject_reason")
    counts = [F.count_if(why.isNull()).alias("accepted"), *[F.count_if(why == r).alias(f"r{i}") for i, r in enumerate(reasons)], F.count_if(why.isNotNull() & ~why.isin(*reasons)).alias("other")]
    df.observe(seen, *counts).where(why.isNull()).drop("reject_reason").write.mode("overwrite").parquet(path)
    got = seen.get
    if not got["accepted"]:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        raise ValueError(f"no {what}")
    return {"accepted": got["accepted"], **{r: got[f"r{i}"] for i, r in enumerate(reasons)}, "other": got["other"]}


def extra_columns(df: DataFrame, expected: Sequence[str]) -> set[str]:
    """Unknown columns; a closed schema has none."""
    return set(df.columns) - set(expected)


def missing_columns(df: DataFrame, expected: Sequence[str]) -> set[str]:
    return set(expected) - set(df.columns)


def require_closed(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    if odd := extra_columns(df, expected):
        raise ValueError(f"unknown columns: {', '.join(sorted(odd))}")
    if lost := missing_columns(df, expected):
        raise ValueError(f"missing columns: {', '.join(sorted(lost))}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def math_faults(raw: Column, problem: Column, difficulty: Column) -> list[tuple[str, Column]]:
    """Reasons to skip a row of the boxed source, in the order in which they are tested."""
    answer = answers.boxed_gold(raw)
    return [
        ("parse_failure", answer.isNull()),
        ("empty_answer", F.length(answers.strip(answer)) == 0),
        ("difficulty_failure", answers.level_fault(difficulty)),
        ("validation_failure", (F.length(F.coalesce(problem, F.lit(""))) < 1) | (F.length(F.coalesce(raw, F.lit(""))) < 1)),
    ]
