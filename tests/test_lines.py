import pytest
from pyspark.sql import functions as F

from quern.sources import lines, readers


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def files(folder):
    """Blank lines, carriage returns, no last line break, one file without any break, an empty one."""
    folder.mkdir()
    rows = {f"f{k}": ["" if i % 5 == 4 else f"{k}-{i}" for i in range(2001 + k)] for k in range(3)}
    for name, x in rows.items():
        (folder / name).write_bytes(("\r\n" if name == "f1" else "\n").join(x).encode() + (b"\n" if name == "f2" else b""))
    (folder / "long").write_bytes(b"x" * 20_000)
    (folder / "none").write_bytes(b"")
    return sorted((i, x) for of in [*rows.values(), ["x" * 20_000]] for i, x in enumerate(of))


def test_lines_of_files_in_blocks(spark, tmp_path, small_blocks):
    want = files(tmp_path / "in")
    out = lines.read(spark, f"file://{tmp_path}/in")
    assert out.rdd.getNumPartitions() > 6
    assert sorted((r.line, r.value) for r in out.collect()) == want
    blocks = lines.counted(spark, f"file://{tmp_path}/in").collect()
    assert sum(r.n for r in blocks) == len(want) and sum(r.filled for r in blocks) == sum(x != "" for _, x in want)


def test_counts_in_a_join_instead_of_a_broadcast(spark, tmp_path, small_blocks, monkeypatch):
    want = files(tmp_path / "in")
    monkeypatch.setattr(lines, "MOST_BLOCKS", 0)
    assert sorted((r.line, r.value) for r in lines.read(spark, f"file://{tmp_path}/in").collect()) == want


def test_lines_are_read_once_after_the_count(spark, tmp_path, small_blocks):
    files(tmp_path / "in")
    plan = lines.read_filled(spark, f"file://{tmp_path}/in")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_other_blocks_than_were_counted_are_an_error(spark, tmp_path, small_blocks):
    files(tmp_path / "in")
    blocks = lines.counted(spark, f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    with pytest.raises(Exception, match="cut otherwise"):
        lines.read(spark, f"file://{tmp_path}/in", blocks).collect()


def test_batches_smaller_than_blocks(spark, tmp_path, small_blocks):
    want = files(tmp_path / "in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted((r.line, r.value) for r in lines.read(spark, f"file://{tmp_path}/in").collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_json_objects_blank_lines_and_faults(spark, tmp_path):
    (tmp_path / "a").write_text('\n{"x": 1}\n \t\n{"x": 2}\n')
    assert sorted((r.line, r.x) for r in readers.read_jsonl(spark, f"file://{tmp_path}/a", "x int").collect()) == [(1, 1), (3, 2)]
    (tmp_path / "b").write_text('{"x": 1}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object in line 2"):
        readers.read_jsonl(spark, f"file://{tmp_path}/b", "x int").collect()
    for text in ("", "\n \r\n"):
        (tmp_path / "c").write_text(text)
        with pytest.raises(ValueError, match="no rows"):
            readers.read_jsonl(spark, f"file://{tmp_path}/c", "x int")
    assert lines.read(spark, f"file://{tmp_path}/c").agg(F.max("line")).first()[0] == 1
