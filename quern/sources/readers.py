"""Scans: parquet, JSONL by line, preference pairs, configuration, and the registry of sources.

Only declarative formats are read; nothing here unpickles or runs what it reads.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import answers, scoring
from quern.operators import validation as v
from quern.sources import lines, shared


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `ordinal` 0, 1, ... in the order of columns, without bringing all rows into one task.

    Rows are dealt out by ranges and written once, a file a range.  A row's number is its place in its file and the rows of
    the files before, so it does not depend on a second reading that deals out alike.  Only a count for each file is brought together.
    """
    spark = df.sparkSession
    path = shared.folder(spark, "ordered")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    rows = spark.read.schema(df.schema).parquet(path).select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__in"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__before"))
    return rows.join(F.broadcast(shift), "__part").withColumn("ordinal", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """line and the fields of each line that isn't blank; a line that is no object is an error that names its number (from 1)."""
    rows = lines.read_filled(spark, path)
    return rows.where(lines.objects(rows)).select("line", "value", F.from_json("value", schema).alias("x")).select("line", "value", "x.*")


CHAIN_FIELDS = ("id", "problem", "question", "prompt", "solution", "reasoning", "response", "trace", "answer", "final_answer", "gold_answer", "level", "difficulty", "topic", "domain", "subtopic")


def hash_examples(raw: DataFrame, split: str, ordinal: str = "ordinal", source: str = "gsm8k") -> DataFrame:
    """Example rows of a question / answer table; an answer without a mark is a reject."""
    null = F.lit(None).cast("string")
    df = raw.select(
        F.concat_ws("-", F.lit(source), F.lit(split), F.col(ordinal).cast("string")).alias("id"), F.lit(source).alias("source"), F.col("question").alias("prompt"), F.col("answer").alias("response"),
        answers.hash_gold(F.col("answer")).alias("final_answer"), F.lit(None).cast("int").alias("difficulty"), *[null.alias(c) for c in v.OPTIONAL], F.col(ordinal).alias("ordinal"),
    )
    return v.validate(df)


def boxed_examples(raw: DataFrame, split: str, ordinal: str = "ordinal", source: str = "math") -> DataFrame:
    """Example rows of a problem / solution table, with the reason for each row that is skipped."""
    null = F.lit(None).cast("string")
    solution = F.col("solution")
    df = raw.select(
        F.concat_ws("-", F.lit(source), F.lit(split), F.col(ordinal).cast("string")).alias("id"), F.lit(source).alias("source"), F.col("problem").alias("prompt"), solution.alias("response"),
        answers.boxed_gold(solution).alias("final_answer"), answers.level(F.col("level")).alias("difficulty"), answers.category_slug(F.col("type")).alias("category"), null.alias("domain"), null.alias("topic"), null.alias("subtopic"),
        F.col(ordinal).alias("ordinal"), v.reason_of(v.math_faults(solution, F.col("problem"), F.col("level"))).alias("reject_reason"),
    )
    return df


def chain_examples(raw: DataFrame, split: str, ordinal: str = "line", source: str = "finchain") -> DataFrame:
    """Example rows of a table with any of the accepted field names (absent ones may be missing)."""
    have = lambda *names: [F.col(n) for n in names if n in raw.columns] or [F.lit(None).cast("string")]
    response = v.first_present(*have("solution", "reasoning", "response", "trace"))
    given = v.first_present(*have("answer", "final_answer", "gold_answer"))
    grade = v.first_present(*have("level", "difficulty"))
    own_id = v.truthy(F.nullif(have("id")[0].cast("string"), F.lit("0")))
    topic, domain, subtopic = (v.truthy(have(c)[0]) for c in ("topic", "domain", "subtopic"))
    df = raw.select(
        F.coalesce(own_id, F.concat_ws("-", F.lit(source), F.lit(split), F.col(ordinal).cast("string"))).alias("id"), F.lit(source).alias("source"),
        v.first_present(*have("problem", "question", "prompt")).alias("prompt"), response.alias("response"), F.coalesce(answers.normal(given), answers.marked(response)).alias("final_answer"),
        answers.difficulty(F.when(grade == "true", "1").otherwise(grade)).alias("difficulty"), topic.alias("category"), domain.alias("domain"), topic.alias("topic"), subtopic.alias("subtopic"), F.col(ordinal).alias("ordinal"),
    )
    return v.validate(df)


def resolve_path(split: str, root: str = "data/finchain", env: str = "FINCHAIN_{}_JSONL") -> str:
    """Path of a split; an environment variable of that name goes first."""
    if split not in ("train", "validation", "test"):
        raise ValueError(f"no such split: {split}")
    return os.environ.get(env.format(split.upper()), f"{root}/{split}.jsonl")


PAIR_SCHEMA = "prompt string, chosen string, rejected string, source string, prompt_id string, chosen_grade map<string,string>, rejected_grade map<string,string>, metadata map<string,string>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Preference pairs: prompt, chosen, rejected and source are required, open maps default to empty."""
    df = read_jsonl(spark, path, PAIR_SCHEMA).drop("value")
    lost = v.reason_of([(c, F.col(c).isNull()) for c in ("prompt", "chosen", "rejected", "source")])
    fault = F.raise_error(F.concat(F.lit("line "), (F.col("line") + 1).cast("string"), F.lit(" lacks "), lost)).cast("boolean")
    df = df.where(F.when(lost.isNull(), F.lit(True)).otherwise(fault))
    empty = F.create_map().cast("map<string,string>")
    return df.withColumns({c: F.coalesce(c, empty) for c in ("chosen_grade", "rejected_grade", "metadata")})


@dataclass(frozen=True)
class SourceSpec:
    """A source: how to read it, how to extract an answer, how to score it, and its token budget. Nothing is read until `load` is called."""

    name: str
    load: Callable[..., DataFrame] | None
    extract: Callable[[Column], Column]
    score: str
    budget: int


REGISTRY: dict[str, SourceSpec] = {
    "gsm8k": SourceSpec("gsm8k", None, answers.hash_generated, "hash", 256),
    "math": SourceSpec("math", None, answers.boxed_generated, "boxed", 768),
    "finchain": SourceSpec("finchain", None, answers.marked, "marked", 256),
}


def register(spec: SourceSpec) -> None:
    REGISTRY[spec.name] = spec


def lookup(name: str) -> SourceSpec:
    if name not in REGISTRY:
        raise ValueError(f"no such source: {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def grade(df: DataFrame, text: str = "completion", gold: str = "gold_answer", source: str = "source") -> DataFrame:
    """`df` with `predicted` and `correct`, each row by the rules of its source; a source that isn't registered, or null, is an error."""
    unknown = F.raise_error(F.concat(F.lit("no such source: "), F.coalesce(F.col(source).cast("string"), F.lit("null"))))
    predicted, correct = unknown.cast("string"), unknown.cast("boolean")
    for name, spec in REGISTRY.items():
        predicted = F.when(F.col(source) == name, spec.extract(F.col(text))).otherwise(predicted)
    df = df.withColumn("predicted", predicted)
    for name, spec in REGISTRY.items():
        correct = F.when(F.col(source) == name, scoring.SCORERS[spec.score](F.col("predicted"), F.col(gold))).otherwise(correct)
    return df.withColumn("correct", correct)


def load_selected(names: Sequence[str], frames: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Bag union of the named sources in that order; others are never read."""
    if not names:
        raise ValueError("no sources are named")
    out = None
    for place, name in enumerate(names):
        if name not in frames:
            raise ValueError(f"no such source: {name}")
        part = frames[name]().withColumn("source_place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out


def with_max_steps(config: dict[str, Any], max_steps: int) -> dict[str, Any]:
    """`config` with another number of steps; a warm-up that would not end before the last step is shortened to end there."""
    training = dict(config.get("training") or {}, max_steps=max_steps)
    if training.get("warmup_steps", 0) >= max_steps:
        training["warmup_steps"] = max(max_steps - 1, 0)
    return dict(config, training=training)


def read_config(path: str, overrides: dict[str, Any] | None = None, known: Iterable[str] = ("model", "data", "training", "packing", "logging", "checkpointing")) -> dict[str, Any]:
    """A YAML mapping with dotted overrides merged in before it is checked."""
    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    return checked_config(config, overrides, known)


def checked_config(config: Any, overrides: dict[str, Any] | None, known: Iterable[str]) -> dict[str, Any]:
    if not isinstance(config, dict):
        raise ValueError("a configuration is a mapping")
    for dotted, value in (overrides or {}).items():
        *outer, last = dotted.split(".")
        at = config
        for key in outer:
            at = at.setdefault(key, {})
        at[last] = value
    if odd := set(config) - set(known):
        raise ValueError(f"unknown keys: {', '.join(sorted(odd))}")
    if (data := config.get("data")) is not None and not data.get("sources", True):
        raise ValueError("no sources are configured")
    training = config.get("training") or {}
    if {"warmup_steps", "max_steps"} <= training.keys() and training["warmup_steps"] >= training["max_steps"]:
        raise ValueError("the warm-up ends before the last step")
    return config


def config_lines(config: dict[str, Any], outer: str = "") -> list[str]:
    """The configuration that is in effect, a line a value, for people and logs."""
    out = []
    for key in sorted(config):
        name, value = f"{outer}{key}", config[key]
        out += config_lines(value, f"{name}.") if isinstance(value, dict) and value else [f"{name}: {json.dumps(value, ensure_ascii=False)}"]
    return out


def metric_history(df: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """Chosen metrics of a run of an exported tracking table (run, _step, metrics); no such run is an error."""
    return v.require_rows(df.where(F.col("run") == run).select("_step", *keys), f"run {run}")
