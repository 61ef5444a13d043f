"""Groups of sampled completions: censuses, preference pairs, buckets, advantages.

Pairs are made on (prompt, sample) alone; wide texts are joined to those that
stay.  A prompt's completions are bounded by how many were sampled, except in
`all_pairs` without a cap, whose output is what was asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.answers import let
from quern.functions.rates import adaptive_weight, success_bucket
from quern.sources import readers

EPSILON = 1e-8


def group_census(df: DataFrame, prompt: str = "prompt_id", correct: str = "correct") -> DataFrame:
    """One row: prompts, pairable, all_correct, all_incorrect, empty."""
    right = F.count_if(F.col(correct))
    by = df.groupBy(prompt).agg(right.alias("right"), F.count("*").alias("n"))
    return by.agg(
        F.count("*").alias("prompts"),
        F.count_if((F.col("right") > 0) & (F.col("right") < F.col("n"))).alias("pairable"),
        F.count_if(F.col("right") == F.col("n")).alias("all_correct"),
        F.count_if(F.col("right") == 0).alias("all_incorrect"),
        F.lit(0).cast("long").alias("empty"),
    )


def completion_totals(df: DataFrame, prompt: str = "prompt_id", correct: str = "correct") -> DataFrame:
    """One row: correct, incorrect, and the pairs that they make."""
    by = df.groupBy(prompt).agg(F.count_if(F.col(correct)).alias("c"), F.count_if(~F.col(correct)).alias("i"))
    zero = F.lit(0).cast("long")
    return by.agg(*[F.coalesce(F.sum(x), zero).alias(n) for n, x in (("correct", F.col("c")), ("incorrect", F.col("i")), ("pairs", F.col("c") * F.col("i")))])


def all_pairs(df: DataFrame, prompt: str = "prompt_id", sample: str = "sample_index", correct: str = "correct", cap: int | None = None, seed: int = 42) -> DataFrame:
    """prompt, chosen_index, rejected_index: each correct with each incorrect completion of a prompt, `cap` of a prompt at most.

    A prompt within the cap keeps all; beyond it that many are drawn (`drawn_pairs`), and no others are formed.
    """
    if cap is not None:
        return drawn_pairs(df, cap, prompt, sample, correct, seed)
    good = df.where(F.col(correct)).select(F.col(prompt), F.col(sample).alias("chosen_index"))
    bad = df.where(~F.col(correct)).select(F.col(prompt), F.col(sample).alias("rejected_index"))
    return good.join(bad, prompt)


def in_order(pairs: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """`pairs` with `ordinal`, in order of prompt, chosen and rejected completion; order is a column, as files and shuffles keep none."""
    return readers.with_ordinal(pairs, prompt, "chosen_index", "rejected_index")


#: rounds of the permutation, and steps back into its range; see `permuted`
ROUNDS, WALK = 4, 64


def permuted(x: Column, size: Column, key: Column) -> Column:
    """Where a permutation of 0 .. size - 1, chosen by the string `key`, takes x.

    A Feistel network on two digits of x, whose bases are about the root of `size`: each round adds a hash of one digit to the
    other.  Their product may exceed `size` by less than a base, so a result that is beyond is permuted again.  That ends within as
    many steps as there are numbers beyond, and each step fails with a chance of a base in `size`: past WALK steps raises.
    """
    base = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    other = F.ceil(size / base).cast("long")
    hashed = lambda k, digit: F.conv(F.substr(F.md5(F.concat_ws(":", key, F.lit(str(k)), digit.cast("string"))), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def once(y: Column) -> Column:
        def turned(k: int, digits: Column) -> Column:
            high, low = digits["high"], digits["low"]
            if k == ROUNDS:
                return high * other + low
            high, low = ((high + hashed(k, low)) % base, low) if k % 2 == 0 else (high, (low + hashed(k, high)) % other)
            return let(F.struct(high.alias("high"), low.alias("low")), lambda d: turned(k + 1, d))

        return let(F.struct(F.floor(y / other).cast("long").alias("high"), (y % other).alias("low")), lambda d: turned(0, d))

    def walked(first: Column) -> Column:
        last = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < size, y).otherwise(once(y)))
        return F.when(first < size, first).otherwise(let(last, lambda y: F.when(y < size, y).otherwise(F.raise_error(F.lit("the permutation did not return into its range")))))

    return let(once(x), walked)


def drawn_pairs(df: DataFrame, cap: int, prompt: str = "prompt_id", sample: str = "sample_index", correct: str = "correct", seed: int = 42) -> DataFrame:
    """prompt, chosen_index, rejected_index: min(cap, c * i) different pairs of a prompt with c correct and i incorrect completions.

    The pairs of a prompt are numbered 0 .. c * i - 1 and a permutation chosen by seed and prompt says which numbers come
    first, so the work is the pairs that are drawn. Completions are numbered in order of prompt and sample without sorting a
    prompt in one task; a number leads to its completion, so a prompt of any size is spread over all tasks.
    """
    if cap < 1:
        raise ValueError("a cap is at least 1")
    rows = readers.with_ordinal(df.where(F.col(correct).isNotNull() & F.col(prompt).isNotNull()).select(F.col(prompt).alias("p"), F.col(correct).alias("right"), F.col(sample).alias("s")), "p", "right", "s")
    side = lambda flag: (F.count_if(flag), F.min(F.when(flag, F.col("ordinal"))))
    (c, good), (i, bad) = side(F.col("right")), side(~F.col("right"))
    by = rows.groupBy("p").agg(c.alias("c"), good.alias("good"), i.alias("i"), bad.alias("bad")).where("c > 0 AND i > 0").withColumn("pairs", F.col("c") * F.col("i"))
    drawn = by.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(cap).cast("long"), "pairs") - 1)).alias("x"))
    drawn = drawn.withColumn("y", permuted(F.col("x"), F.col("pairs"), F.concat_ws(":", F.lit(str(seed)), F.col("p").cast("string"))))
    drawn = drawn.select("p", (F.col("good") + F.floor(F.col("y") / F.col("i"))).cast("long").alias("chosen"), (F.col("bad") + F.col("y") % F.col("i")).alias("rejected"))
    at = lambda number, name: rows.select(F.col("ordinal").alias(number), F.col("s").alias(name))
    out = drawn.join(at("chosen", "chosen_index"), "chosen").join(at("rejected", "rejected_index"), "rejected")
    return out.select(F.col("p").alias(prompt), "chosen_index", "rejected_index")


def with_texts(pairs: DataFrame, df: DataFrame, prompt: str = "prompt_id", sample: str = "sample_index", text: str = "completion") -> DataFrame:
    """`pairs` with the texts `chosen` and `rejected`."""
    side = lambda index, name: df.select(F.col(prompt), F.col(sample).alias(index), F.col(text).alias(name))
    return pairs.join(side("chosen_index", "chosen"), [prompt, "chosen_index"]).join(side("rejected_index", "rejected"), [prompt, "rejected_index"])


def one_to_one_pairs(df: DataFrame, prompt: str = "prompt_id", sample: str = "sample_index", correct: str = "correct") -> DataFrame:
    """The k-th correct with the k-th incorrect completion of a prompt, as many as the scarcer side has."""
    rank = F.row_number().over(Window.partitionBy(prompt, correct).orderBy(sample))
    ranked = df.where(F.col(correct).isNotNull()).select(prompt, correct, sample, rank.alias("rank"))
    good = ranked.where(F.col(correct)).select(prompt, "rank", F.col(sample).alias("chosen_index"))
    bad = ranked.where(~F.col(correct)).select(prompt, "rank", F.col(sample).alias("rejected_index"))
    return good.join(bad, [prompt, "rank"])


def best_worst(df: DataFrame, prompt: str = "prompt_id", reward: str = "reward", order: str = "ordinal", min_margin: float = 0.0, text: str = "prompt") -> DataFrame:
    """One pair per prompt: the best reward (of equals the latest) against the worst (of equals the earliest).

    Prompts with one completion, or a margin that isn't above `min_margin`, have none. Two prompt texts under one id are an
    error. One mergeable aggregation, no sort. Columns: chosen_order, rejected_order, rewards, margin, success_rate, bucket,
    weight, first_order (groups in order of appearance).
    """
    x = F.struct(F.col(reward).alias("reward"), F.col(order).alias("order"))
    checks = [F.min(text).alias("lo"), F.max(text).alias("hi")] if text in df.columns else []
    by = df.groupBy(prompt).agg(
        F.max(x).alias("best"), F.min(x).alias("worst"), F.count("*").alias("n"), F.avg((F.col(reward) > 0).cast("double")).alias("success_rate"), F.min(order).alias("first_order"), *checks,
    )
    by = by.where(F.col("n") >= 2)
    if checks:
        fault = F.raise_error(F.concat(F.lit("one prompt id, several prompts: "), F.col(prompt).cast("string"))).cast("boolean")
        by = by.where(F.when(F.col("lo") == F.col("hi"), F.lit(True)).otherwise(fault))
    margin = F.col("best.reward") - F.col("worst.reward")
    bucket = success_bucket(F.col("success_rate"))
    return by.where(margin > min_margin).select(
        prompt, F.col("best.order").alias("chosen_order"), F.col("worst.order").alias("rejected_order"),
        F.col("best.reward").alias("chosen_reward"), F.col("worst.reward").alias("rejected_reward"), margin.alias("margin"),
        "success_rate", bucket.alias("bucket"), adaptive_weight(bucket).alias("weight"), "first_order",
    )


def bucketed(df: DataFrame, prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """prompt, n, success_rate, bucket."""
    by = df.groupBy(prompt).agg(F.count("*").alias("n"), F.avg((F.col(reward) > 0).cast("double")).alias("success_rate"))
    return by.withColumn("bucket", success_bucket(F.col("success_rate")))


def advantage(prompt: str = "prompt_id", reward: str = "reward", normalize: bool = True, eps: float = EPSILON) -> Column:
    """(reward - mean) / population deviation inside a prompt's group; 0 where all rewards are alike."""
    group = Window.partitionBy(prompt)
    centred = F.col(reward) - F.avg(reward).over(group)
    if not normalize:
        return centred
    sd = F.stddev_pop(reward).over(group)
    return F.when(sd > eps, centred / F.greatest(sd, F.lit(eps))).otherwise(0.0)


def with_advantages(df: DataFrame, prompt: str = "prompt_id", reward: str = "reward", normalize: bool = True, single: str = "fail") -> DataFrame:
    """`df` with `advantage`. A group of one has none and raises; under `drop` such rows go."""
    if single not in ("fail", "drop"):
        raise ValueError(f"no such policy: {single}")
    size = F.count("*").over(Window.partitionBy(prompt))
    df = df.withColumn("__n", size)
    if single == "fail":
        fault = F.raise_error(F.concat(F.lit("a group of one: "), F.col(prompt).cast("string"))).cast("boolean")
        df = df.where(F.when(F.col("__n") >= 2, F.lit(True)).otherwise(fault))
    else:
        df = df.where(F.col("__n") >= 2)
    return df.withColumn("advantage", advantage(prompt, reward, normalize)).drop("__n")


def first_appearance(prompt: str = "prompt_id", order: str = "ordinal") -> Column:
    """Sort key that brings groups into the order in which they first appear."""
    return F.min(order).over(Window.partitionBy(prompt))


def yield_gate(df: DataFrame, least: float, prompt: str = "prompt_id", correct: str = "correct") -> DataFrame:
    """The census with `pair_yield` and whether it is at least `least`."""
    share = F.when(F.col("prompts") > 0, F.col("pairable") / F.col("prompts")).otherwise(0.0)
    return group_census(df, prompt, correct).withColumn("pair_yield", share).withColumn("passes", share >= least)


def resample_plan(buckets: DataFrame, extra: int = 12) -> DataFrame:
    """prompt rows of ambiguous buckets, once per further sample (`sample_index` continues after `n`)."""
    return buckets.where(F.col("bucket") == "ambiguous").select("*", F.explode(F.sequence(F.col("n"), F.col("n") + extra - 1)).alias("sample_index"))


def to_dpo_example(pairs: DataFrame) -> DataFrame:
    """Pairs with grades as structs and the weight as `opd_weight` in a copy of the metadata map."""
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in pairs.columns else F.create_map().cast("map<string,string>")
    return pairs.withColumns({
        "chosen_grade": F.struct(F.col("chosen_reward").alias("reward")),
        "rejected_grade": F.struct(F.col("rejected_reward").alias("reward")),
        "metadata": F.map_concat(F.map_filter(metadata, lambda k, _: k != "opd_weight"), F.create_map(F.lit("opd_weight"), F.col("weight").cast("string"))),
    })


def add_metadata(df: DataFrame, more: dict[str, str], column: str = "metadata") -> DataFrame:
    """`more` on top of each row's metadata."""
    own = F.map_filter(F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*more))
    return df.withColumn(column, F.map_concat(own, F.create_map(*[F.lit(str(x)) for kv in more.items() for x in kv])))


def to_pair(df: DataFrame) -> DataFrame:
    """Chosen and rejected columns of a pair as the nested record that trainers read."""
    grade = lambda side: F.struct(F.col(f"{side}_answer").alias("predicted_answer"), F.col(f"{side}_correct").alias("correct"))
    return df.select("prompt_id", "prompt", "source", "chosen", "rejected", grade("chosen").alias("chosen_grade"), grade("rejected").alias("rejected_grade"), "metadata")


def expand_samples(df: DataFrame, k: int) -> DataFrame:
    """Each row k times, `sample_index` from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"))


def budget(source: Column, default: int, overrides: dict[str, int] | None = None) -> Column:
    """Token budget of a row's source."""
    for s, n in (overrides or {}).items():
        if n <= 0:
            raise ValueError(f"the budget of {s} is positive")
    if default <= 0:
        raise ValueError("a budget is positive")
    if not overrides:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(default))
