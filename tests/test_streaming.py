import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import commits, ledger, stateful

SCHEMA = "id long, k string, t timestamp, x double"


@pytest.fixture(autouse=True)
def rocks(spark):
    stateful.use_rocks(spark)


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{n}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(f"{folder}/part*")


def minute(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_count_windows_go_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("aab"), minute(i), float(i)) for i in range(100)] + [(200, None, minute(1), 1.0), (201, None, minute(1), 2.0)]
    for n, part in enumerate((rows[:40], rows[40:41], rows[41:])):
        shuffled = list(part)
        rnd.shuffle(shuffled)
        put(spark, tmp_path / "in", n, shuffled)
        ledger.run_available(stateful.count_windows(source(spark, tmp_path / "in"), "k", "x", "id", 7), f"{tmp_path}/out", f"{tmp_path}/state")
    want = set()
    for k in ("a", "b", None):
        mine = [r for r in rows if r[1] == k]
        want |= {(k, w, 7, sum(r[3] for r in mine[7 * w : 7 * w + 7])) for w in range(len(mine) // 7)}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    with pytest.raises(ValueError):
        stateful.count_windows(source(spark, tmp_path / "in"), "k", "x", "id", 0)


def test_sessions_close_by_timer_merge_and_drop_late_rows(spark, tmp_path):
    gap = 10 * 60_000
    run = lambda: ledger.run_available(stateful.sessions(source(spark, tmp_path / "in"), "k", "t", "x", gap, "30 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    put(spark, tmp_path / "in", 0, [(0, "a", minute(0), 1.0), (1, "a", minute(16), 2.0), (2, "b", minute(3), 4.0)])
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0
    put(spark, tmp_path / "in", 1, [(3, "a", minute(8), 8.0), (4, "c", minute(500), 1.0)])  # joins both sessions of a
    run()
    put(spark, tmp_path / "in", 2, [(5, "b", minute(4), 100.0), (6, "c", minute(900), 1.0)])  # the first is late by then
    assert run() == 1
    got = {(r.k, r.start, r.end, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", minute(0), minute(16), 3, 11.0), ("b", minute(3), minute(3), 1, 4.0), ("c", minute(500), minute(500), 1, 1.0)}


def test_sessions_at_the_gap_and_without_a_call_for_each_key(spark, tmp_path):
    gap = 10 * 60_000
    ms = lambda m, x: minute(m) + dt.timedelta(microseconds=x)
    # the gap exactly, a millisecond less, and a part of a millisecond less, which does not count
    rows = [(0, "a", minute(0), 1.0), (1, "a", minute(10), 2.0), (2, "b", minute(0), 1.0), (3, "b", ms(10, -1000), 2.0), (4, "c", ms(0, 900), 1.0), (5, "c", ms(10, 100), 2.0), (6, None, minute(1), 3.0)]
    put(spark, tmp_path / "in", 0, rows)
    # the watermark is a millisecond short of the end of d, then on it
    put(spark, tmp_path / "in", 1, [(7, "d", minute(490), 4.0), (8, "e", ms(530, -1000), 1.0)])
    df = stateful.sessions(source(spark, tmp_path / "in"), "k", "t", "x", gap, "30 minutes")
    assert "Pandas" not in df._jdf.queryExecution().toString()
    run = lambda: ledger.run_available(df, f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    got = lambda: sorted(((r.k, r.start, r.end, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    early = [("a", minute(0), minute(0), 1, 1.0), ("a", minute(10), minute(10), 1, 2.0), ("b", minute(0), ms(10, -1000), 2, 3.0), ("c", minute(0), minute(0), 1, 1.0), ("c", minute(10), minute(10), 1, 2.0), (None, minute(1), minute(1), 1, 3.0)]
    assert got() == sorted(early, key=str)
    put(spark, tmp_path / "in", 2, [(9, "e", minute(530), 1.0)])
    run()
    assert got() == sorted([*early, ("d", minute(490), minute(490), 1, 4.0)], key=str)


def test_requests_pass_once_across_batches_and_restarts(spark, tmp_path):
    rows = [(i, None if i % 6 == 5 else f"k{i % 6}", minute(i), float(i % 2)) for i in range(60)]
    for n, part in enumerate((rows[30:], rows[:30], rows)):
        put(spark, tmp_path / "in", n, part)
        ledger.run_available(stateful.first_of_each(source(spark, tmp_path / "in"), ["k", "x"], "id", lanes=3), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.id for r in got) == list(range(30, 36)) and len({(r.k, r.x) for r in got}) == 6


def test_a_batch_is_taken_once_and_half_a_batch_is_not_seen(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/ledger"
    df = lambda n: spark.range(n).toDF("x")
    schema = df(1).schema
    assert commits.read(spark, root, schema).count() == 0 and commits.committed(spark, root) == []
    assert commits.append(df(3), root, 0) and not commits.append(df(9), root, 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            commits.append(df(50), root, 1)
    assert (tmp_path / "ledger" / "batch=1").exists()
    assert commits.read(spark, root, schema).count() == 3
    assert commits.append(df(4), root, 1)  # the repeated batch replaces what the dead attempt has left
    assert sorted((r.batch, r.x) for r in commits.read(spark, root, schema).collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert commits.manifest(spark, root, 1) == {"batch": 1, "rows": 4, "columns": ["x"]}
    monkeypatch.setattr(commits, "LISTED", 1)
    assert commits.read(spark, root, schema).groupBy("batch").count().count() == 2


def test_a_stream_that_dies_between_write_and_commit(spark, tmp_path, monkeypatch):
    root, rows = f"file://{tmp_path}/ledger", [(i, "a" if i % 3 else "b", minute(i), 1.0) for i in range(90)]
    run = lambda: ledger.run_upsert(ledger.windowed(source(spark, tmp_path / "in"), "t", "x", "20 minutes", keys=("k",)), f"{tmp_path}/state", commits.sink(root))
    put(spark, tmp_path / "in", 0, rows[:50])
    run()
    put(spark, tmp_path / "in", 1, rows[50:])
    whole = commits._commit
    with monkeypatch.context() as m:
        m.setattr(commits, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    assert commits._commit is whole
    run()
    schema = "start timestamp, k string, n long, total double"
    versions = commits.read(spark, root, spark.createDataFrame([], schema).schema)
    got = {(r.start, r.k): (r.n, r.total) for r in commits.latest(versions, ["start", "k"]).collect()}
    want = {}
    for _, k, t, x in rows:
        key = (t.replace(minute=t.minute // 20 * 20), k)
        n, total = want.get(key, (0, 0.0))
        want[key] = (n + 1, total + x)
    assert got == want
    assert versions.groupBy("start", "k").agg(F.count("*").alias("n")).where("n > 1").count() > 0  # a window that went on has two versions
