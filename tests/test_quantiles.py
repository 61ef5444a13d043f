import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import metrics, quantiles

PLACES = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "late": lambda n: F.floor(n * 0.95), "last": lambda n: n - 1, "none": lambda n: n}


def want(values):
    x = sorted(values, key=lambda v: (math.isnan(v), v))
    n = len(x)
    return n, x[0], x[n // 2], x[math.floor(n * 0.95)], x[-1], None


def close(a, b):
    return all(x == y or (x is not None and y is not None and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("kind", ["int", "long", "double", "smallint"])
def test_against_sorting(spark, kind):
    rnd = random.Random(kind)
    make = {
        "int": lambda: rnd.choice([rnd.randint(-(2**31), 2**31 - 1), rnd.randint(0, 9), -(2**31), 2**31 - 1]), "smallint": lambda: rnd.randint(-(2**15), 2**15 - 1),
        "long": lambda: rnd.choice([rnd.randint(-(2**63), 2**63 - 1), 5, -(2**63), 2**63 - 1]), "double": lambda: rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e300), 5e-324, -0.0, 0.0, float("inf"), float("-inf"), 1.0]),
    }[kind]
    rows = [(rnd.choice(["a", "a", "b", None]), make()) for _ in range(400)] + [("one", make()), ("a", None), ("null", None)]
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    got = {r.k: tuple(r)[1:] for r in quantiles.at_places(df.repartition(5), "v", PLACES, ["k"]).collect()}
    keys = {k for k, v in rows if v is not None}
    assert got.keys() == keys
    for k in keys:
        assert close(got[k], want([v for n, v in rows if n == k and v is not None]))
    (one,) = quantiles.at_places(df, "v", PLACES).collect()
    assert close(tuple(one), want([v for _, v in rows if v is not None]))
    assert dict(quantiles.at_places(df, "v", PLACES).dtypes)["mid"] == {"long": "bigint"}.get(kind, kind)


def test_order_of_floating_point_numbers():
    x = np.array([float("-inf"), -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")])
    i = quantiles.to_order(x)
    assert (np.diff(i.astype(object)) > 0).all() and quantiles.to_order(np.array([-0.0]))[0] == i[4]
    back = quantiles.from_order(i)
    assert (back[:-1] == x[:-1]).all() and math.isnan(back[-1])


def test_nan_nothing_and_other_types(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert close(tuple(quantiles.at_places(df, "v", PLACES).first()), want([float("nan"), 1.0, 2.0]))
    assert quantiles.at_places(df.limit(0), "v", PLACES, []).collect() == []
    with pytest.raises(ValueError, match="no number"):
        quantiles.at_places(df.select(F.col("v").cast("string")), "v", PLACES)


def test_no_window_is_larger_than_a_histogram(spark):
    """Many different values, no keys: what windows and sorts get is bins."""
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_000_007).alias("v"))
    values = sorted(r.v for r in df.collect())
    r = metrics.length_stats(df, "v").first()
    assert (r["count"], r.p50, r.p95, r["max"]) == (200_000, values[100_000], values[190_000], values[-1])
    plan = quantiles.at_places(df, "v", {"p50": PLACES["mid"]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 6 and all("digit" in x for x in plan.split("\n") if "Window [" in x)
