import glob

import pytest
from pyspark.sql import functions as F

from quern.operators import metrics, sampling, validation
from quern.plans import views
from quern.sources import cache, footers, readers


def test_an_unknown_source_is_an_error(spark):
    df = spark.createDataFrame([("#### 1", "1", "gsm8k"), ("#### 1", "1", "other")], "completion string, gold_answer string, source string")
    assert [r.correct for r in readers.grade(df.where("source = 'gsm8k'")).collect()] == [True]
    with pytest.raises(Exception, match="no such source: other"):
        readers.grade(df).collect()
    with pytest.raises(Exception, match="no such source: null"):
        metrics.accuracy(readers.grade(df.withColumn("source", F.lit(None).cast("string"))), ["source"]).collect()


def test_lengths_of_nothing_are_an_error(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), ("b", 5)], "k string, n int")
    assert metrics.length_stats(df, "n").first()["count"] == 2
    for empty in (df.limit(0), df.where("n is null")):
        for keys in ([], ["k"]):
            with pytest.raises(ValueError, match="no values of n"):
                metrics.length_stats(empty, "n", keys)
    with pytest.raises(ValueError):
        metrics.column_length_stats(df.limit(0), ["n"])


def test_rejects_are_counted_by_the_write(spark, tmp_path):
    df = spark.range(1000).withColumn("reject_reason", F.when(F.col("id") % 10 == 0, "ten").when(F.col("id") % 10 == 1, "one").when(F.col("id") % 100 == 2, "odd"))
    got = validation.write_accepted(df.repartition(7), f"{tmp_path}/out", ["ten", "one", "never"])
    assert got == {"accepted": 790, "ten": 100, "one": 100, "never": 0, "other": 10}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == ["id"] and out.count() == 790
    with pytest.raises(ValueError, match="no examples"):
        validation.write_accepted(df.where("reject_reason is not null"), f"{tmp_path}/none", ["ten"], "examples")
    assert not (tmp_path / "none").exists()


def test_a_cache_in_buckets_moves_the_requests_alone(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    c = cache.Bucketed(spark, path, "key string, answer long", buckets=4)
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 100).alias("key"), F.col("id").alias("answer"))
    assert c.missing(rows).count() == 100
    c.append(rows.where("id < 60").dropDuplicates(["key"]).select("key", F.lit(1).cast("long").alias("answer")))
    c.append(rows.where("id < 60").dropDuplicates(["key"]).select("key", F.lit(2).cast("long").alias("answer")))  # adds nothing
    assert c.rows().count() == 60 and c.rows().agg(F.sum("answer")).first()[0] == 60
    assert len(glob.glob(f"{tmp_path}/cache/*.parquet")) <= 4
    left = c.missing(rows.unionByName(spark.createDataFrame([(None, 1)], "key string, answer long")))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")  # that of the requests
    assert sorted(r.key or "" for r in left.collect()) == ["", *sorted(f"k{i}" for i in range(60, 100))]
    again = cache.Bucketed(spark, path, "key string, answer long", buckets=4)
    assert again.found(rows.select("key", F.col("answer").alias("asked"))).count() == 300


def test_drift_names_the_files(spark, tmp_path):
    df = spark.range(30).select("id", F.lit(1.5).alias("x"), F.lit("s").alias("s"), F.array(F.lit(1)).alias("a"))
    df.write.parquet(f"{tmp_path}/t/p=1")
    df.drop("x").withColumn("s", F.lit(3)).withColumn("more", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/t/p=2")
    out = footers.drift(spark, f"file://{tmp_path}/t", df.schema).collect()
    odd = {(r.file.split("/")[-2], r.name, r.expected, r.found, r.drift) for r in out if r.drift != "same"}
    assert odd == {("p=2", "x", "double", None, "missing"), ("p=2", "s", "string", "int", "retyped"), ("p=2", "more", None, "int", "extra")}
    assert sum({r.file: r.rows for r in out}.values()) == 60
    with pytest.raises(ValueError, match=r"p=2/.*: more is extra; .*s is retyped \(int instead of string\); .*x is missing"):
        footers.require_no_drift(spark, f"file://{tmp_path}/t", df.schema)
    footers.require_no_drift(spark, f"file://{tmp_path}/t/p=1", df.schema)
    footers.require_no_drift(spark, f"file://{tmp_path}/t", df.schema, ("missing", "extra", "retyped"))


def test_a_split_reads_its_table_three_times(spark, sf_dir, tmp_path):
    """Once for the counts, once for the last rows of shares, once for the result."""
    views.sizes(spark, sf_dir).write.parquet(f"{tmp_path}/docs")
    out = sampling.stratified_split(spark.read.parquet(f"{tmp_path}/docs"), 10, "doc_id", "lang")
    assert out._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/docs") == 1
