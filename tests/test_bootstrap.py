import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bootstrap


def plain(rows, rounds, seed):
    """Row by row and round by round with Python's integers."""

    def mix(x):
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        return x ^ x >> 16

    def draws(key, r):
        digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
        high, low = int(digest[:8], 16), int(digest[8:16], 16)
        x = mix(high ^ mix((low + r * 0x9E3779B9) & 0xFFFFFFFF)) / 2**32
        k, chance = 0, math.exp(-1)
        while x >= math.floor(chance * 2**32) / 2**32 and k < 13:
            k += 1
            chance += math.exp(-1) / math.factorial(k)
        return k

    out = {}
    for g in {r[0] for r in rows if r[2] is not None}:
        mine = [(k, v) for h, k, v in rows if h == g and v is not None]
        means = []
        for r in range(rounds):
            w = [draws(k, r) for k, _ in mine]
            if sum(w):
                means.append(sum(a * v for a, (_, v) in zip(w, mine, strict=True)) / sum(w))
        means.sort()
        at = lambda s: means[math.floor(len(means) * s)] if means else None
        out[g] = (len(mine), sum(v for _, v in mine) / len(mine), at(0.025), at(0.975))
    return out


def cases(spark):
    rows = [("a", k, float(k % 7)) for k in range(60)] + [("b", 100, 5.0), (None, 101, 1.0), (None, 102, 2.0), ("a", 103, None), ("none", 104, None), ("a", 1, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, id long, v double")


def close(got, want):
    assert got.keys() == want.keys()
    for g, x in want.items():
        assert got[g] == pytest.approx(x)


@pytest.mark.parametrize("rounds, held", [(1, None), (40, None), (200, 1)])
def test_against_plain_integers(spark, monkeypatch, rounds, held):
    rows, df = cases(spark)
    if held:
        monkeypatch.setattr(bootstrap, "HELD", held)
        monkeypatch.setattr(bootstrap, "CHUNK", 7 * rounds)
    out = bootstrap.bootstrap_ci(df.repartition(3), "v", "id", rounds, 5, ["g"])
    assert out.columns == ["g", "n", "mean", "lo", "hi"]
    close({r.g: tuple(r)[1:] for r in out.collect()}, plain(rows, rounds, 5))


def test_no_keys_several_keys_and_no_rows(spark):
    rows, df = cases(spark)
    one = bootstrap.bootstrap_ci(df, "v", "id", 30).first()
    close({"": tuple(one)}, plain([("", k, v) for _, k, v in rows], 30, 42))
    two = bootstrap.bootstrap_ci(df.withColumn("h", F.col("id") % 2), "v", "id", 30, keys=["h", "g"])
    close({(r.h, r.g): tuple(r)[2:] for r in two.collect()}, plain([((k % 2, g), k, v) for g, k, v in rows], 30, 42))
    assert bootstrap.bootstrap_ci(df.limit(0), "v", "id").collect() == [] and bootstrap.bootstrap_ci(df.limit(0), "v", "id", keys=["g"]).collect() == []
    with pytest.raises(ValueError):
        bootstrap.bootstrap_ci(df, "v", "id", 0)


def test_draws_are_poisson_and_rounds_are_apart():
    rng = np.random.default_rng(1)
    w = bootstrap.weights(rng.integers(0, 1 << 32, 20_000), rng.integers(0, 1 << 32, 20_000), 50)
    for k, share in enumerate([0.3679, 0.3679, 0.1839, 0.0613]):
        assert abs((w == k).mean() - share) < 0.003
    assert abs(np.corrcoef(w.T) - np.eye(50)).max() < 0.04  # of rounds
    assert abs(np.corrcoef(w[:300]) - np.eye(300)).max() < 0.75  # of rows, by 50 draws each
    assert bootstrap.steps()[-1] == (1 << 32) - 1 and len(bootstrap.steps()) < 14


def test_the_interval_covers_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("x"))
    a, b = (bootstrap.bootstrap_ci(df.repartition(n), "x", "id").first() for n in (1, 7))
    assert a.mean == 0.5 and a.lo == pytest.approx(b.lo) and 0.42 < a.lo < 0.5 < a.hi < 0.58
