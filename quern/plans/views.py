"""Views that the registered queries share, as frames; `oracles` states the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sampled completions: a prompt is a user's day, purchases and sign-ups are correct."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    correct = F.col("event_type").isin("purchase", "signup")
    order = Window.partitionBy("prompt_id").orderBy("event_id")
    df = e.select(
        F.col("event_id").alias("ordinal"), "event_id", "user_id", "event_type", "value", "props", "ts", F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("prompt_id"),
        correct.alias("correct"), correct.cast("double").alias("reward"), F.element_at(F.array(F.lit("gsm8k"), F.lit("math"), F.lit("finchain")), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("source"),
    )
    return df.withColumns({"sample_index": (F.row_number().over(order) - 1).cast("long"), "prompt": F.concat(F.lit("task "), F.col("prompt_id"))})


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded texts: each source's answer form, one event in seven without an answer, gold off by one where incorrect.

    Gold answers are spelled plainly, with an exponent, with forty more digits, with an underscore and with a sign.
    """
    e = table(spark, sf_dir, "events")
    v = money(F.col("value"))
    source = F.element_at(F.array(F.lit("gsm8k"), F.lit("math"), F.lit("finchain")), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    text = (
        F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("no result"))
        .when(source == "gsm8k", F.concat(F.lit("first #### 1\nthen\n#### $"), v, F.lit(". done")))
        .when(source == "math", F.concat(F.lit("so $\\boxed{1}$ or \\boxed{"), v, F.lit("}$")))
        .otherwise(F.concat(F.lit("Answer: 1\nFinal Answer: $"), v, F.lit("% of all")))
    )
    plain = money(F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(F.col("value") + 1), 3)
    form = F.pmod("event_id", F.lit(5))
    gold = F.when(form == 0, plain).when(form == 1, F.concat(F.replace(plain, F.lit("."), F.lit("")), F.lit("e-3"))).when(form == 2, F.concat(plain, F.repeat(F.lit("0"), 40))).when(form == 3, F.concat(F.lit("0_0"), plain)).otherwise(F.concat(F.lit("+"), plain))
    return e.select(F.col("event_id").alias("example_id"), F.col("event_type").alias("checkpoint"), source.alias("source"), text.alias("completion"), gold.alias("gold_answer"), "value", "user_id")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length, a character a token."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("n_tokens"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.token_rows import sft_examples

    return sft_examples(table(spark, sf_dir, "conversations"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def chain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chains of steps, a reference and a response that drops, rewords, changes, adds and reverses steps by rule."""
    line = table(spark, sf_dir, "lineitem")
    price, more = money(F.col("l_extendedprice")), money(F.col("l_extendedprice") + 1, 1)
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lead = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" comes to "))
    gold = F.concat(F.lit("Step "), at.cast("string"), F.lit(": "), lead, price)
    part = F.col("l_partkey")
    said = F.when(part % 7 == 1, F.concat(F.lit("- so we get "), price, F.lit("0."))).when(part % 11 == 2, F.concat(lead, more)).otherwise(F.concat(at.cast("string"), F.lit(") "), lead, price))
    said = F.when(F.col("l_suppkey") % 6 == 0, F.concat(said, F.lit("\nlet us check that"))).otherwise(said)
    turn = F.when(F.col("l_orderkey") % 4 == 0, -at).otherwise(at)
    steps = line.select("l_orderkey", at.alias("at"), turn.alias("turn"), gold.alias("gold"), F.when(part % 5 != 0, said).alias("said"))
    told = lambda c, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c]), "\n")
    return steps.groupBy(F.col("l_orderkey").alias("chain_id")).agg(told("gold", "at").alias("gold_chain"), told("said", "turn").alias("response_chain"))
