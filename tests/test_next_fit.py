import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import next_fit


def one_by_one(n, room, fill=0, row=0):
    out = []
    for k in n:
        if fill > 0 and fill + k + 1 > room:
            row, fill = row + 1, 0
        start = fill + 1 if fill else 0
        fill = start + k
        out.append((row, start))
    return out, fill, row


def lengths(rnd, count, room, zeros=0.2):
    return np.array([0 if rnd.random() < zeros else min(room, rnd.choice([1, 2, room // 3 + 1, room, rnd.randint(1, room)])) for _ in range(count)], np.int64)


def test_a_run_from_every_fill():
    rnd = random.Random(1)
    for _ in range(150):
        room = rnd.choice([1, 2, 5, 9, 30])
        n = lengths(rnd, rnd.choice([1, 2, 3, 10, 60]), room)
        run = next_fit.Run(n, room)
        steps = run.steps()
        for fill in range(room + 1):
            want, last, rows = one_by_one(n, room, fill)
            assert run.leave(fill) == (last, rows) == tuple(int(x) for x in steps(fill))
            number, start = run.places(fill, 0)
            assert list(zip(number.tolist(), start.tolist(), strict=True)) == want


def test_maps_and_summaries_compose():
    rnd = random.Random(2)
    for _ in range(200):
        room = rnd.choice([1, 3, 8, 20])
        sizes = [rnd.randint(1, 12) for _ in range(4)]
        n = lengths(rnd, sum(sizes), room)
        names = sorted(rnd.choice([None, "a", "b", "c"]) or "" for _ in n) if rnd.random() < 0.7 else ["a"] * len(n)
        batch = pa.array([x or None for x in names], pa.string())
        cuts = np.append(0, np.cumsum(sizes))
        parts = [next_fit.summary_of(batch.slice(a, b - a), n[a:b], room) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        both = parts[0]
        for p in parts[1:]:
            both = both.then(p, room)
        whole = next_fit.summary_of(batch, n, room)
        for state in [(batch[0].as_py(), rnd.randint(0, room), 5), ("other", 1, 7)]:
            step = state
            for p in parts:
                step = p.leave(*step)
            assert whole.leave(*state) == both.leave(*state) == step


def test_steps_are_few():
    rnd = random.Random(3)
    steps = next_fit.Run(np.array([rnd.randint(1, 400) for _ in range(5000)]), 2048).steps()
    assert len(steps.begin) < 40  # of 2049 fills


@pytest.mark.parametrize("block, fan", [(1, 2), (7, 3), (64, 2), (None, None)])
def test_against_one_fold(spark, block, fan):
    rnd = random.Random(4)
    rows = [(b, k, int(x)) for b, size in (("hot", 400), ("b", 1), ("c", 150), (None, 30), ("d", 2)) for k, x in enumerate(lengths(rnd, size, 50))]
    want = {}
    for b in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == b]
        for r, (row, start) in zip(mine, one_by_one([r[2] for r in mine], 50)[0], strict=True):
            want[b, r[1]] = (row, start, start + r[2])
    rnd.shuffle(rows)
    out = next_fit.pack(spark.createDataFrame(rows, "b string, k int, n int"), "b", "k", "n", 50, block, fan)
    assert out.columns == ["b", "k", "row_no", "start", "end"]
    assert {(r.b, r.k): (r.row_no, r.start, r.end) for r in out.collect()} == want


def test_long_null_and_no_documents(spark):
    rows = [(1, 1, 90), (1, 2, None), (1, 3, 5), (1, 4, 0), (1, 4, 3), (1, 4, 3)]
    df = spark.createDataFrame(rows, "b long, k long, n long")
    got = sorted((r.k, r.row_no, r.start, r.end) for r in next_fit.pack(df, "b", "k", "n", 10).collect())
    # a row that is full, an empty document that would need a separator, the rest by the room that is left
    assert got == [(1, 0, 0, 10), (2, 1, 0, 0), (3, 1, 0, 5), (4, 1, 6, 6), (4, 1, 7, 10), (4, 2, 0, 3)]
    assert next_fit.pack(df.limit(0), "b", "k", "n", 10).collect() == []
    with pytest.raises(ValueError):
        next_fit.pack(df, "b", "k", "n", 0)


def test_a_batch_far_beyond_a_block(spark):
    df = spark.range(60_000).select(F.lit(1).alias("b"), "id", (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("n"))
    rows = {r.id: (r.row_no, r.start) for r in next_fit.pack(df, "b", "id", "n", 2048, 1000, 8).collect()}
    want = one_by_one([r.n for r in df.orderBy("id").collect()], 2048)[0]
    assert [rows[i] for i in range(60_000)] == want
