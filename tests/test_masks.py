import random

import pytest
from pyspark.sql import functions as F

from quern.operators import masks
from quern.operators.token_rows import isolated_mask


def rows(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        ids, doc = [], 0
        while len(ids) < rnd.randrange(14):
            kind = rnd.choice("dds.")
            ids += [doc] * rnd.randint(1, 4) if kind == "d" else [-1] if kind == "s" else [-2] * rnd.randint(1, 2)
            doc += 1
        out.append(ids)
    return [*out, [], [0], [-1], [0, 1], [0] * 9, [0, 0, -1, 1, 1, -2]]


def square(ids):
    return [[int((d >= 0 and d == e and j <= i) or (d < 0 and i == j)) for j, e in enumerate(ids)] for i, d in enumerate(ids)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, ids) for k, ids in enumerate(rows(1))], "k long, ids array<long>").withColumn("mask", masks.of_doc_ids(F.col("ids")))


def test_dense_and_visible_are_those_of_the_square(frame):
    got = frame.select("ids", masks.dense(F.col("mask")).alias("d"), masks.visible(F.col("mask")).alias("n"), isolated_mask(F.col("ids")).alias("s")).collect()
    for r in got:
        assert r.d == r.s == square(r.ids) and r.n == sum(map(sum, r.d))


def test_positions_are_the_rows_of_the_square(frame):
    got = {}
    for r in masks.positions(frame, "mask", "k").collect():
        got.setdefault(r.k, {})[r.query] = r.first_key
    for k, ids in enumerate(rows(1)):
        assert got.get(k, {}) == {i: min(j for j, x in enumerate(line) if x) for i, line in enumerate(square(ids))}
        assert all(sum(line) == i - got[k][i] + 1 for i, line in enumerate(square(ids)))


def test_slices(frame):
    for a, b in ((0, 4), (2, 7), (3, 3), (5, 2), (-2, 100), (50, 60)):
        for r in frame.select("ids", masks.dense(masks.sliced(F.col("mask"), F.lit(a), F.lit(b))).alias("d")).collect():
            whole, lo = square(r.ids), max(a, 0)
            want = [line[lo : max(b, lo)] for line in whole[lo : max(b, lo)]]
            assert r.d == want


def test_rows_behind_each_other_and_unions(spark, frame):
    two = frame.select(F.array("mask", masks.of_doc_ids(F.reverse("ids")), "mask").alias("m"), F.concat("ids", F.transform(F.reverse("ids"), lambda x: F.when(x >= 0, x + 100).otherwise(x)), F.transform("ids", lambda x: F.when(x >= 0, x + 200).otherwise(x))).alias("all"))
    for r in two.select("all", masks.dense(masks.behind(F.col("m"))).alias("d")).collect():
        assert r.d == square(r["all"])
    halves = frame.select("ids", masks.union(masks.of_doc_ids(F.transform("ids", lambda x: F.when(x % 2 == 0, x).otherwise(-1))), masks.of_doc_ids(F.transform("ids", lambda x: F.when(x % 2 == 1, x).otherwise(-1)))).alias("u"))
    for r in halves.select("ids", masks.dense(F.col("u")).alias("d")).collect():
        assert r.d == square(r.ids)
    clash = spark.range(1).select(masks.union(masks.of_doc_ids(F.array(F.lit(0), F.lit(0))), masks.of_doc_ids(F.array(F.lit(-1), F.lit(0), F.lit(0)))).alias("u"))
    with pytest.raises(Exception, match="overlap"):
        clash.collect()


def test_of_boundaries(spark):
    df = spark.createDataFrame([([(0, 3), (4, 6), (7, 7)], 9)], "b array<struct<start: long, end: long>>, w int")
    row = df.select(masks.of_boundaries(F.col("b"), F.col("w")).alias("m")).select(masks.dense(F.col("m")).alias("d"), *[masks.allows(F.col("m"), F.lit(q), F.lit(k)).alias(f"a{q}_{k}") for q, k in ((1, 0), (0, 1), (5, 2), (8, 8), (9, 9))]).first()
    assert row.d == square([0, 0, 0, -1, 1, 1, -2, -2, -2]) and list(row)[1:] == [True, False, False, True, False]
