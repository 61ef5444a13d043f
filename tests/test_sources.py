import json

import pytest
from pyspark.sql import functions as F

from quern.plans.views import table
from quern.sources import cache, readers, writers


def test_chain_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    lines = [{"problem": "p", "solution": "Final Answer: $1,210.00", "level": "hard", "topic": "t"}, None, {"id": 0, "question": " ", "prompt": "q", "trace": "so 5%", "difficulty": 9}, {"id": "own", "prompt": "z", "response": "r", "answer": " $7. "}, {"prompt": "z", "response": "none"}]
    path.write_text("\n".join("" if x is None else json.dumps(x) for x in lines) + "\n")
    raw = readers.read_jsonl(spark, f"file://{path}", ", ".join(f"{c} string" for c in readers.CHAIN_FIELDS))
    out = {r.id: r for r in readers.chain_examples(raw, "train").collect()}
    assert out.keys() == {"finchain-train-0", "finchain-train-2", "own", "finchain-train-4"}
    assert (out["finchain-train-0"].final_answer, out["finchain-train-0"].difficulty, out["finchain-train-0"].category) == ("1210.00", 5, "t")
    assert (out["finchain-train-2"].prompt, out["finchain-train-2"].final_answer, out["finchain-train-2"].difficulty) == ("q", "5", None)
    assert out["own"].final_answer == "7" and out["finchain-train-4"].reject_reason == "final_answer_empty"
    path.write_text('{"prompt": "a"}\n\n[1]\n')
    with pytest.raises(Exception, match="line 3"):
        readers.read_jsonl(spark, f"file://{path}", "prompt string").collect()
    path.write_text("\n \n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_jsonl(spark, f"file://{path}", "prompt string")


def test_jsonl_is_ascii(spark, tmp_path):
    rows = [("é世🙂\n\"\\", None), ("plain", "x")]
    writers.write_jsonl(spark.createDataFrame(rows, "a string, b string"), f"{tmp_path}/out")
    text = "".join(p.read_text("ascii") for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(text.splitlines()) == sorted(json.dumps({"a": a, "b": b}, separators=(",", ":")) for a, b in rows)


def test_fewer_steps_shorten_the_warm_up():
    config = {"training": {"max_steps": 100, "warmup_steps": 10}, "data": {"sources": ["math"]}}
    assert readers.with_max_steps(config, 5)["training"] == {"max_steps": 5, "warmup_steps": 4}
    assert readers.with_max_steps(config, 0)["training"]["warmup_steps"] == 0
    assert readers.with_max_steps(config, 50)["training"] == {"max_steps": 50, "warmup_steps": 10} and config["training"]["max_steps"] == 100


def test_pairs_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    row = {"prompt": "p", "chosen": "c", "rejected": "r", "source": "math"}
    path.write_text(json.dumps(row) + "\n" + json.dumps(row | {"metadata": {"a": 1}, "chosen_grade": {"correct": True}}) + "\n")
    out = readers.read_pairs(spark, f"file://{path}").orderBy("line").collect()
    assert [r.metadata for r in out] == [{}, {"a": "1"}] and out[1].chosen_grade == {"correct": "true"}
    path.write_text(json.dumps(row | {"chosen": None}) + "\n")
    with pytest.raises(Exception, match="lacks chosen"):
        readers.read_pairs(spark, f"file://{path}").collect()


def test_example_tables(spark):
    q = spark.createDataFrame([(0, "q", "so #### $5"), (1, "q", "none")], "ordinal long, question string, answer string")
    assert [(r.id, r.final_answer, r.reject_reason) for r in readers.hash_examples(q, "test").collect()] == [("gsm8k-test-0", "$5", None), ("gsm8k-test-1", None, "final_answer_empty")]
    m = spark.createDataFrame([(0, "p", r"\boxed{4}", "Level 3", "Counting & Probability"), (1, "p", "x", "Level 9", "a"), (2, "p", r"\boxed{}", "Level 1", "a"), (3, "p", r"\boxed{1}", "hard", "a")], "ordinal long, problem string, solution string, level string, type string")
    assert [(r.id, r.difficulty, r.category, r.reject_reason) for r in readers.boxed_examples(m, "train").collect()] == [
        ("math-train-0", 3, "counting_and_probability", None), ("math-train-1", None, "a", "parse_failure"), ("math-train-2", 1, "a", "empty_answer"), ("math-train-3", None, "a", "difficulty_failure"),
    ]


def test_registry(spark):
    df = spark.createDataFrame([("gsm8k", "#### 5.0", "5"), ("math", r"\boxed{\frac12}", r"\dfrac{1}{2}"), ("finchain", "answer: 5%", "$5"), ("other", "5", "5")], "source string, completion string, gold_answer string")
    assert [r.correct for r in readers.grade(df).collect()] == [True, True, True, False]
    with pytest.raises(ValueError, match="no such source"):
        readers.lookup("none")
    readers.register(readers.SourceSpec("echo", None, lambda x: F.trim(x), "hash", 8))
    try:
        assert readers.grade(spark.createDataFrame([("echo", " 5 ", "5")], df.schema)).first().correct
    finally:
        readers.REGISTRY.pop("echo")
    read = []
    frames = {k: (lambda k=k: read.append(k) or df) for k in ("a", "b", "c")}
    assert readers.load_selected(["c", "a"], frames).count() == 8 and read == ["c", "a"]


def test_ordinals(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(9)
    numbered = readers.with_ordinal(df, "x")
    for out in (numbered.collect(), numbered.repartition(3).collect()):
        assert all(r.ordinal == r.x for r in out) and len(out) == 1000
    names = spark.createDataFrame([(f"n{k:03}",) for k in range(50)], "name string")
    assert sorted(r.ordinal for r in readers.with_ordinal(names, "name").collect()) == list(range(50))
    assert readers.with_ordinal(df.limit(0), "x").collect() == []


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("training: {max_steps: 10, warmup_steps: 2}\ndata: {sources: [math]}\n")
    assert readers.read_config(str(path), {"training.max_steps": 20})["training"]["max_steps"] == 20
    for bad, why in (("- 1\n", "mapping"), ("x: 1\n", "unknown"), ("data: {sources: []}\n", "no sources"), ("training: {max_steps: 2, warmup_steps: 2}\n", "warm-up")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=why):
            readers.read_config(str(path))
    import yaml

    config = {"training": {"max_steps": 3}, "model": {"name": "é"}}
    assert yaml.safe_load(writers.config_text(config)) == config
    monkeypatch.setenv("FINCHAIN_TRAIN_JSONL", "/x")
    assert readers.resolve_path("train") == "/x" and readers.resolve_path("test") == "data/finchain/test.jsonl"


def test_sinks(spark, tmp_path):
    rows = [("a", "math", "1", "p, q", 'line\nbreak "x", y', "1", None, False, False), ("b", "gsm8k", "2", "p", "", "2", "2", True, True)]
    df = spark.createDataFrame(rows, "checkpoint string, source string, example_id string, prompt string, generated string, gold_answer string, predicted_answer string, parse_success boolean, is_correct boolean")
    writers.write_details(df, f"{tmp_path}/details")
    back = {r.example_id: r for r in writers.read_details(spark, f"{tmp_path}/details").collect()}
    assert back["1"].generated == 'line\nbreak "x", y' and not back["1"].predicted_answer and back["2"].checkpoint == "b"
    with pytest.raises(Exception, match="safe name"):
        writers.write_details(df.withColumn("checkpoint", F.lit("../x")), f"{tmp_path}/other")
    summary = spark.createDataFrame([("a", "math", 2, 0.5, 1.0, 10, 8, 1.5)], ", ".join(f"{c} {t}" for c, t in zip(writers.SUMMARY, ("string", "string", "long", "double", "double", "long", "long", "double"), strict=True)))
    for _ in range(2):
        writers.write_summary(summary, f"{tmp_path}/summary")
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary/csv").columns == list(writers.SUMMARY)
    writers.write_record(spark, f"{tmp_path}/manifest", {"b": 1, "a": {"x": None}})
    assert writers.read_record(spark, f"{tmp_path}/manifest") == {"b": 1, "a": {"x": None}}
    for _ in range(2):
        writers.append_event(df.select("example_id"), f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 4
    assert writers.parse_checkpoints(["a=/x", "b.1=/y=z"]) == {"a": "/x", "b.1": "/y=z"}
    for bad in (["a"], ["../x=/y"], [".=/x"], ["a=1", "a=2"], ["a\n=/x"], ["=x"]):
        with pytest.raises(ValueError):
            writers.parse_checkpoints(bad)


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    root = f"file://{tmp_path}/cache"
    for parts in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert cache.cached(spark, root, parts, make).count() == 5
    assert len(made) == 2 and cache.fingerprint(spark, root)
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "p string, q string").withColumn("key", cache.row_key("p", "q"))
    assert df.select("key").distinct().count() == 2 and cache.missing(df, df.limit(1), ["key"]).count() == 1
