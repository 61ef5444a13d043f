"""Reports: accuracy, lengths, tokens, cost, losses, pivots.

Counts are bigint and rates double.  A rate over no rows is 0.0, a mean of no
tokens is NaN where the report says perplexity and null elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.kernels import IGNORED
from quern.operators import quantiles
from quern.operators.validation import require_rows


def share(flag: Column) -> Column:
    """Share of all rows where `flag` holds; null counts as no, no rows as 0.0."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, keys: Sequence[str], correct: str = "correct", predicted: str = "predicted") -> DataFrame:
    """keys, n, accuracy, parse_success_rate."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col(correct)).alias("accuracy"), share(F.col(predicted).isNotNull()).alias("parse_success_rate"))


def accuracy_rollup(df: DataFrame, keys: Sequence[str], correct: str = "correct", predicted: str = "predicted") -> DataFrame:
    """`accuracy` with subtotals (an extension)."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), share(F.col(correct)).alias("accuracy"), share(F.col(predicted).isNotNull()).alias("parse_success_rate"))


def grade_summary(df: DataFrame, grade: str = "grade") -> DataFrame:
    """One row: n, parse_success_rate, final_answer_accuracy, all double; zeros for an empty frame."""
    return df.agg(F.count("*").cast("double").alias("n"), share(F.col(f"{grade}.parse_success")).alias("parse_success_rate"), share(F.col(f"{grade}.final_answer_correct")).alias("final_answer_accuracy"))


def length_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, count, mean, p50, p95, max; the percentiles are the values at places floor(n/2) and floor(0.95 n) in order.

    Ranks values by counts of equal ones, so a group's rows never meet in one task: equal values are counted first, and
    running counts are taken over a key's distinct values only; without keys, the places are found by digit histograms
    (`quantiles`). No values at all are an error.
    """
    require_rows(df.where(F.col(value).isNotNull()), f"values of {value}")
    if not keys:
        places = quantiles.at_places(df, value, {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n.cast("double") * 0.95)})
        whole = df.agg(F.avg(F.col(value).cast("double")).alias("mean"), F.max(value).alias("max"))
        return places.crossJoin(F.broadcast(whole)).select("count", "mean", "p50", "p95", "max")
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by.withColumns({"end": F.sum("c").over(upto), "n": F.sum("c").over(group)})
    at = lambda place: F.min(F.when(F.col("end") > place, F.col("v")))
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("count"), (F.sum(F.col("v").cast("double") * F.col("c")) / F.sum("c")).alias("mean"),
        at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n").cast("double") * 0.95)).alias("p95"), F.max("v").alias("max"),
    )


def column_length_stats(df: DataFrame, columns: Sequence[str], total: str = "total") -> DataFrame:
    """`length_stats` of each column and of their sum, long form: name, count, mean, p50, p95, max."""
    every = [F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in columns]
    every.append(F.struct(F.lit(total).alias("name"), sum((F.col(c).cast("long") for c in columns[1:]), F.col(columns[0]).cast("long")).alias("value")))
    return length_stats(df.select(F.explode(F.array(*every)).alias("x")).select("x.*"), "value", ["name"])


def frequency(df: DataFrame, column: str) -> DataFrame:
    """value, n in order of value, null last."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last(column))


def counts_for(df: DataFrame, listed: Sequence[str], column: str = "source") -> DataFrame:
    """Rows of each listed value, 0 for those that have none."""
    every = df.sparkSession.createDataFrame([(x,) for x in listed], f"{column} string")
    by = df.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(by, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def token_counts(df: DataFrame, batch: str, length: str) -> DataFrame:
    """batch, rectangular (rows times longest), tokens (sum of lengths)."""
    return df.groupBy(batch).agg((F.count("*") * F.max(length)).cast("long").alias("rectangular"), F.sum(length).cast("long").alias("tokens"))


def non_pad(ids: Column, pad: int | None) -> Column:
    """Tokens that aren't padding; without a padding id all count."""
    return F.size(ids) if pad is None else F.size(F.filter(ids, lambda x: x != pad))


def run_totals(df: DataFrame, tokens: str, decoded: str, seconds: str) -> DataFrame:
    """One row: generated_tokens, generated_tokens_decoded, generation_sec, tokens_per_sec (0 if nothing ran)."""
    zero = F.lit(0).cast("long")
    one = df.agg(F.coalesce(F.sum(tokens).cast("long"), zero).alias("generated_tokens"), F.coalesce(F.sum(decoded).cast("long"), zero).alias("generated_tokens_decoded"), F.coalesce(F.sum(seconds).cast("double"), F.lit(0.0)).alias("generation_sec"))
    return one.withColumn("tokens_per_sec", F.when(F.col("generation_sec") > 0, F.col("generated_tokens") / F.col("generation_sec")).otherwise(0.0))


def estimate(sampled: DataFrame, checkpoints: int, n: str = "n", budget: str = "budget", per_sec: float = 100.0) -> DataFrame:
    """One row before a run: generations, worst_tokens (all at the largest budget), hours at `per_sec` tokens."""
    one = sampled.agg((F.sum(n) * checkpoints).cast("long").alias("generations"), F.max(budget).alias("most"))
    return one.select("generations", (F.col("generations") * F.col("most")).cast("long").alias("worst_tokens"), (F.col("generations") * F.col("most") / per_sec / 3600).alias("hours"))


def cost_summary(totals: DataFrame, elapsed_sec: float, per_hour: float | None) -> DataFrame:
    """`run_totals` with elapsed time, hours and dollars; no rate, no dollars."""
    hours = F.lit(elapsed_sec / 3600.0)
    return totals.withColumns({"elapsed_sec": F.lit(float(elapsed_sec)), "hours": hours, "rate": F.lit(per_hour).cast("double"), "cost": hours * F.lit(per_hour).cast("double")})


def cost_ledger(df: DataFrame, keys: Sequence[str], tokens: str, seconds: str, predicted: str, correct: str, per_hour: float) -> DataFrame:
    """keys, tokens, verifier_calls, gpu_hours, dollars, parse_rate, accuracy, and parsed and correct answers for a dollar (null where nothing was spent).

    A verifier call is a row that is graded.
    """
    parsed, right = F.count(predicted), F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    hours = F.coalesce(F.sum(seconds).cast("double"), F.lit(0.0)) / 3600
    by = df.groupBy(*keys).agg(F.sum(tokens).cast("long").alias("tokens"), F.count("*").alias("verifier_calls"), hours.alias("gpu_hours"), parsed.alias("__parsed"), right.alias("__right"))
    by = by.withColumn("dollars", F.col("gpu_hours") * per_hour)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return by.select(
        *keys, "tokens", "verifier_calls", "gpu_hours", "dollars", ratio("__parsed", "verifier_calls").alias("parse_rate"), ratio("__right", "verifier_calls").alias("accuracy"),
        ratio("__parsed", "dollars").alias("parsed_per_dollar"), ratio("__right", "dollars").alias("correct_per_dollar"),
    )


def mean_of_batch_means(df: DataFrame, batch: str, loss: str) -> DataFrame:
    return df.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"))


def token_weighted_loss(df: DataFrame, nll: str, tokens: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, loss, perplexity, tokens; NaN without tokens."""
    by = df.groupBy(*keys).agg(F.sum(nll).alias("s"), F.coalesce(F.sum(tokens).cast("long"), F.lit(0).cast("long")).alias("tokens"))
    loss = F.when(F.col("tokens") > 0, F.col("s") / F.col("tokens")).otherwise(float("nan"))
    return by.select(*keys, loss.alias("loss"), F.exp(loss).alias("perplexity"), "tokens")


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """One row per `row`, a column for each listed value."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value, ignorenulls=True))


def count_windows(df: DataFrame, ordinal: str, size: int, aggregates: dict[str, Column]) -> DataFrame:
    """Tumbling windows of `size` rows by place: window, then the aggregates; a last part window gives nothing."""
    by = df.groupBy(F.floor(F.col(ordinal) / size).cast("long").alias("window")).agg(F.count("*").alias("__n"), *[c.alias(k) for k, c in aggregates.items()])
    return by.where(F.col("__n") == size).drop("__n")


def useful_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def split_label(label: Column) -> tuple[Column, Column]:
    """`arm-step` at its last hyphen: (arm, step), step null where it isn't a number."""
    pattern = r"(?s)^(.*)-([^-]*)\z"
    arm = F.when(label.rlike(pattern), F.regexp_extract(label, pattern, 1)).otherwise(label)
    return arm, F.regexp_extract(label, pattern, 2).try_cast("long")


def trajectory(base: DataFrame, runs: DataFrame, label: str = "checkpoint") -> DataFrame:
    """Rows of `base` as arm `base`, step 0, and of `runs` by their label, in order of source, arm, step."""
    arm, step = split_label(F.col(label))
    first = base.withColumns({"arm": F.lit("base"), "step": F.lit(0).cast("long")})
    return first.unionByName(runs.withColumns({"arm": arm, "step": step})).orderBy("source", "arm", "step")


def reuse(summary: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of an earlier summary that are wanted, keys that still have to be measured)."""
    keys = list(keys)
    return summary.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.join(summary.select(*keys).distinct(), keys, "left_anti")


def comparison(summary: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy rows of each method beside its token and cost totals; a method without totals keeps its row."""
    return summary.join(totals, list(keys), "left")


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose metrics are all there."""
    return df.dropna(subset=list(columns))


def length_line(name: Column) -> Column:
    """A row of `length_stats` as a line for people."""
    return F.format_string("%s: n=%d mean=%.1f p50=%d p95=%d max=%d", name, "count", "mean", "p50", "p95", "max")


# -- extensions: planned in the field's practice, not in the parity list -------------------


def pass_at_k(df: DataFrame, k: int, prompt: str = "prompt_id", correct: str = "correct") -> DataFrame:
    """One row: prompts with at least k samples, and the mean unbiased pass@k over them."""
    by = df.groupBy(prompt).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("c")).where(F.col("n") >= k)
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.col("n") - F.col("c") - i, F.lit(0)) / (F.col("n") - i))
    return by.agg(F.count("*").alias("prompts"), F.coalesce(F.avg(1.0 - miss), F.lit(0.0)).alias("pass_at_k"))


def per_group_accuracy(df: DataFrame, keys: Sequence[str], correct: str = "correct") -> DataFrame:
    """keys, n, failures, accuracy (failure tables by topic or template)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(correct), F.lit(False))).alias("failures"), share(F.col(correct)).alias("accuracy"))


def cost_per_point(cost: Column, accuracy: Column, base: Column) -> Column:
    """Dollars for each point of accuracy above the base; null if there is none."""
    gain = (accuracy - base) * 100
    return F.when(gain > 0, cost / gain)
