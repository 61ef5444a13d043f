"""Registered queries of sources, sinks and reports: sinks write to the shared folder, and what is read back is reported."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern.functions import answers, rates
from quern.operators import grouping, metrics, sampling, validation
from quern.plans import views as v
from quern.plans.queries import query, rounded
from quern.sources import cache, footers, readers, shared, writers


@query
def ordinal_examples(spark, sf_dir):
    """Examples numbered in the order of a column."""
    e = v.table(spark, sf_dir, "events")
    raw = e.select(F.struct("value", "event_id").alias("place"), F.lit("q").alias("question"), F.concat(F.lit("so #### "), v.money(F.col("value"))).alias("answer"))
    return readers.hash_examples(readers.with_ordinal(raw, "place"), "train").select("id", "final_answer", "ordinal")


@query
def split_paths(spark, sf_dir):
    """Documents by split, each split with the path that it is read from."""
    names = ("train", "validation", "test")
    paths = spark.createDataFrame([(s, readers.resolve_path(s)) for s in names], "split string, path string")
    split = F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    by = v.table(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(paths), "split").select("split", "path", "n")


@query
def pairs_jsonl(spark, sf_dir):
    """Preference pairs as JSON lines, with characters beyond ASCII, and back."""
    df = v.rollouts(spark, sf_dir).withColumn("completion", v.money(F.col("value")))
    pairs = grouping.with_texts(grouping.all_pairs(df, cap=2), df).join(df.select("prompt_id", "source", "prompt").distinct(), "prompt_id")
    path = shared.folder(spark, "pairs")
    writers.write_jsonl(pairs.select("prompt", F.concat(F.lit("größer "), "chosen", F.lit(" 🙂")).alias("chosen"), "rejected", "source", "prompt_id"), path)
    return readers.read_pairs(spark, path).select("prompt_id", "source", "chosen", "rejected", F.size("metadata").cast("long").alias("n_metadata"))


@query
def jsonl_lines(spark, sf_dir):
    """Line numbers of sixteen files, which tasks read in blocks; every second and third line is blank, and counts."""
    path = shared.folder(spark, "lines")
    e = v.table(spark, sf_dir, "events").select("event_id", "event_type", F.pmod("event_id", F.lit(16)).alias("part"))
    line = F.concat(F.to_json(F.struct("event_id", "event_type")), F.lit("\n\n"))
    e.repartition("part").sortWithinPartitions("part", "event_id").select("part", line.alias("value")).write.partitionBy("part").text(path)
    read = readers.read_jsonl(spark, path, "event_id long, event_type string")
    return read.select((F.col("line") / 3).cast("long").alias("line"), "event_type")


@query
def config_round_trip(spark, sf_dir):
    """A configuration for the table's languages and size, with overrides, written, read and listed; the steps follow from the rows."""
    import yaml

    d = v.table(spark, sf_dir, "documents")
    found = d.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("langs")).first()
    config = readers.checked_config({"training": {"max_steps": 10, "warmup_steps": 9}, "data": {"sources": ["gsm8k"]}}, {"data.sources": found.langs}, ("training", "data"))
    back = yaml.safe_load(writers.config_text(readers.with_max_steps(config, found.n // 8)))
    return spark.createDataFrame([(x,) for x in readers.config_lines(back)], "line string")


@query
def summary_round_trip(spark, sf_dir):
    graded = readers.grade(v.completions(spark, sf_dir))
    df = rounded(metrics.accuracy(graded, ["checkpoint", "source"]), "accuracy", "parse_success_rate")
    zero = F.lit(0).cast("long")
    path = shared.folder(spark, "summary")
    writers.write_summary(df.withColumns({"generated_tokens": zero, "generated_tokens_decoded": zero, "elapsed_sec": F.lit(1.5)}), path)
    schema = "checkpoint string, source string, n long, accuracy double, parse_success_rate double, generated_tokens long, generated_tokens_decoded long, elapsed_sec double"
    parts = {"csv": spark.read.schema(schema).option("header", True).csv(f"{path}/csv"), "json": spark.read.schema(schema).json(f"{path}/json")}
    both = parts["csv"].withColumn("form", F.lit("csv")).unionByName(parts["json"].withColumn("form", F.lit("json")))
    return both.select("form", "checkpoint", "source", "n", "accuracy")


@query
def details_round_trip(spark, sf_dir):
    g = readers.grade(v.completions(spark, sf_dir))
    df = g.select(
        "checkpoint", "source", F.col("example_id").cast("string").alias("example_id"), F.lit("p, q").alias("prompt"), F.col("completion").alias("generated"), "gold_answer", F.col("predicted").alias("predicted_answer"),
        F.col("predicted").isNotNull().alias("parse_success"), F.col("correct").alias("is_correct"),
    )
    path = shared.folder(spark, "details")
    writers.write_details(df, path)
    back = writers.read_details(spark, path)
    return back.groupBy("checkpoint", "source").agg(F.count("*").alias("n"), F.sum(F.length("generated")).alias("chars"), F.count_if("parse_success").alias("predicted"), F.count_if("is_correct").alias("n_correct"))


@query
def schema_drift(spark, sf_dir):
    """Which parts of a table lack, add or retype a column, and how many rows these have, from the files' footers."""
    path, e = shared.folder(spark, "drift"), v.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    parts = [e, e.drop("value"), e.withColumn("user_id", F.col("user_id").cast("string")).withColumn("reward", F.col("value"))]
    for k, part in enumerate(parts):
        part.where(F.pmod("event_id", F.lit(3)) == k).write.parquet(f"{path}/part={k}")
    found = footers.drift(spark, path, e.schema).where("drift <> 'same'")
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return found.groupBy(part.alias("part"), "name", "drift").agg(F.sum("rows").alias("n"))


@query
def metric_history(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("_step"), F.col("value").alias("loss"))
    return readers.metric_history(e, "click", ["loss"])


@query
def metric_log(spark, sf_dir):
    path = shared.folder(spark, "metrics")
    e = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.lit("loss").alias("name"), "value")
    for _ in range(2):
        writers.append_metrics(e, path)
    return spark.read.parquet(path).groupBy("run", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def record_round_trip(spark, sf_dir):
    """A manifest with counts, written and read."""
    path = shared.folder(spark, "record")
    counts = {r.event_type: r.n for r in v.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    writers.write_record(spark, path, {"rows": sum(counts.values()), "counts": counts, "note": {"é": None}})
    return spark.createDataFrame([(k, json.dumps(x, ensure_ascii=False)) for k, x in writers.read_record(spark, path).items()], "key string, value string")


@query
def ledger_append(spark, sf_dir):
    path = shared.folder(spark, "ledger")
    e = v.table(spark, sf_dir, "events").select("event_id", "event_type")
    for _ in range(2):
        writers.append_event(e, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def safe_names(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.when(F.pmod("p_size", F.lit(2)) == 0, "-").otherwise("/"))
    return p.select(name.alias("name")).distinct().withColumn("safe", F.col("name").rlike(writers.SAFE))


@query
def cached_table(spark, sf_dir):
    """Made on the first call, read on the second."""
    made = []

    def make():
        made.append(1)
        return v.table(spark, sf_dir, "documents").select("lang")

    root = shared.folder(spark, "cache")
    parts = {"table": "documents", "files": cache.fingerprint(spark, f"{sf_dir}/documents.parquet")}
    for _ in range(2):
        df = cache.cached(spark, root, parts, make)
    return df.groupBy("lang").agg(F.count("*").alias("n")).withColumn("hit", F.lit(len(made) == 1))


@query
def overwritten_table(spark, sf_dir):
    path = shared.folder(spark, "overwritten")
    d = v.table(spark, sf_dir, "documents").select("doc_id")
    for df in (d.limit(3), d):
        writers.write_jsonl(df, path)
    return spark.read.schema("doc_id long").json(path).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query
def length_report(spark, sf_dir):
    stats = metrics.length_stats(v.sizes(spark, sf_dir), "n_tokens", ["lang"])
    return stats.select("lang", metrics.length_line(F.col("lang")).alias("line"))


@query
def verified_only(spark, sf_dir):
    return readers.grade(v.completions(spark, sf_dir)).where("correct").groupBy("source").agg(F.count("*").alias("n"), F.sum("example_id").alias("ids"))


@query
def finite_losses(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    return e.withColumn("value", rates.finite(F.col("value"), F.col("event_id"))).groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query
def required_rows(spark, sf_dir):
    return validation.require_rows(v.table(spark, sf_dir, "events"), "events").agg(F.count("*").alias("n"))


@query
def transfer_accuracy(spark, sf_dir):
    """A second benchmark: another source with rules of its own."""
    readers.register(readers.SourceSpec("transfer", None, answers.hash_generated, "hash", 128))
    try:
        df = v.completions(spark, sf_dir).withColumn("source", F.lit("transfer"))
        return rounded(metrics.accuracy(readers.grade(df), ["source"]), "accuracy", "parse_success_rate")
    finally:
        readers.REGISTRY.pop("transfer")


@query
def cost_ledger(spark, sf_dir):
    """What each run cost, and what was got for it."""
    g = readers.grade(v.completions(spark, sf_dir)).withColumns({"tokens": F.length("completion"), "sec": F.col("value") / 100})
    out = metrics.cost_ledger(g, ["checkpoint"], "tokens", "sec", "predicted", "correct", 0.44)
    return rounded(out, "gpu_hours", "dollars", "parse_rate", "accuracy", "parsed_per_dollar", "correct_per_dollar")


@query
def python_shuffle_places(spark, sf_dir):
    """Places that Python's own generator deals out in each language (no SQL has it; tested against Python)."""
    return sampling.python_shuffle(v.sizes(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", "42")
