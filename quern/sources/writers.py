"""Sinks. Spark's committer makes every write atomic: a lost task or job leaves no part behind."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: fixed columns of the two reports
SUMMARY = ("checkpoint", "source", "n", "accuracy", "parse_success_rate", "generated_tokens", "generated_tokens_decoded", "elapsed_sec")
DETAILS = ("example_id", "prompt", "generated", "gold_answer", "predicted_answer", "parse_success", "is_correct")
#: fixed set of characters of names; `.` and `..` would be other folders
SAFE = r"^(?!\.{1,2}\z)[A-Za-z0-9_.-]+\z"
_NAME = re.compile(SAFE.replace(r"\z", r"\Z"))


def safe_name(name: str) -> str:
    """A name that can be a folder."""
    if not _NAME.match(name):
        raise ValueError(f"not a safe name: {name!r}")
    return name


def parse_checkpoint(pair: str) -> tuple[str, str]:
    """`name=path`."""
    name, found, path = pair.partition("=")
    if not found or not path:
        raise ValueError(f"expected name=path: {pair!r}")
    return safe_name(name), path


def parse_checkpoints(pairs: Sequence[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, path in map(parse_checkpoint, pairs):
        if name in out:
            raise ValueError(f"given twice: {name}")
        out[name] = path
    return out


def _warn_if_there(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and len(fs.listStatus(target)):
        log.warning("%s isn't empty and is overwritten", path)


def write_summary(df: DataFrame, path: str) -> None:
    """A few report rows as one CSV and one JSON file, columns in a fixed order."""
    df = df.select(*SUMMARY).orderBy("checkpoint", "source")
    _warn_if_there(df.sparkSession, path)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def write_details(df: DataFrame, path: str) -> None:
    """Detail rows by checkpoint and source; line breaks and commas in texts survive, a missing prediction is empty."""
    ok = F.col("checkpoint").rlike(SAFE) & F.col("source").rlike(SAFE)
    df = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("not a safe name")).cast("boolean")))
    df = df.select("checkpoint", "source", *DETAILS).withColumn("predicted_answer", F.coalesce("predicted_answer", F.lit("")))
    _warn_if_there(df.sparkSession, path)
    df.write.mode("overwrite").partitionBy("checkpoint", "source").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    schema = "example_id string, prompt string, generated string, gold_answer string, predicted_answer string, parse_success boolean, is_correct boolean, checkpoint string, source string"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, nulls written, characters beyond ASCII as escapes (of UTF-16 units, as JSON has them)."""

    def escaped(c: Column) -> Column:
        high = F.lpad(F.lower(F.hex(F.lit(0xD800) + F.floor((F.ascii(c) - 0x10000) / 1024))), 4, "0")
        low = F.lpad(F.lower(F.hex(F.lit(0xDC00) + F.pmod(F.ascii(c) - 0x10000, F.lit(1024)))), 4, "0")
        unit = F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")
        return F.when(F.octet_length(c) == 1, c).when(F.ascii(c) < 0x10000, F.concat(F.lit("\\u"), unit)).otherwise(F.concat(F.lit("\\u"), high, F.lit("\\u"), low))

    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    plain = F.when(F.octet_length(line) == F.length(line), line).otherwise(F.array_join(F.transform(F.split(line, ""), escaped), ""))
    df.select(plain.alias("value")).write.mode("overwrite").text(path)


def write_record(spark: SparkSession, path: str, record: dict[str, Any]) -> None:
    """One object, keys in order (manifests, cost and run records)."""
    import json

    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict[str, Any]:
    import json

    return json.loads(spark.read.text(path).first().value)


def append_event(df: DataFrame, path: str) -> None:
    """Ledger rows behind those that are there."""
    df.write.mode("append").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Metric rows by step (long form: run, step, name, value)."""
    df.select("run", "step", "name", "value").write.mode("append").parquet(path)


def config_text(config: dict[str, Any]) -> str:
    """YAML that reads back as the same mapping."""
    return yaml.safe_dump(config, sort_keys=True, allow_unicode=True)
