import functools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chains


def best(a, b):
    """All of it by recursion: matches, then exact ones, then earliest moves."""
    far = min(len(a), len(b)) + 1

    @functools.cache
    def cost(i, j):
        if i == len(a) or j == len(b):
            return (len(a) - i + len(b) - j) * far
        found = [cost(i + 1, j) + far, cost(i, j + 1) + far]
        if a[i][0] == b[j][0]:
            found.append(cost(i + 1, j + 1) + (a[i][1] != b[j][1]))
        return min(found)

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0] and cost(i, j) == cost(i + 1, j + 1) + (a[i][1] != b[j][1]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif cost(i, j) == cost(i + 1, j) + far:
            i += 1
        else:
            j += 1
    return out


def lists(chain):
    return np.array([k for k, _ in chain], np.int64), np.array([w for _, w in chain], np.int64)


def solved(pairs, band=1):
    got = chains.align_lists([lists(a) for a, _ in pairs], [lists(b) for _, b in pairs], band)
    return [list(map(tuple, p.tolist())) for p in got]


def random_pairs(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a = [(rnd.randrange(6), rnd.randrange(2)) for _ in range(rnd.randrange(12))]
        b = [x for x in a if rnd.random() < 0.8] if rnd.random() < 0.7 else [(rnd.randrange(6), rnd.randrange(2)) for _ in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(4)):
            b.insert(rnd.randrange(len(b) + 1), (rnd.randrange(6), rnd.randrange(2)))
        out.append((a, b))
    return out


@pytest.mark.parametrize("band", [0, 1, 4, 50])
def test_places_are_those_of_the_whole_table(band):
    pairs = random_pairs(400, band)
    assert solved(pairs, max(band, 1)) == [best(a, b) for a, b in pairs]


def test_a_stretch_of_one_row_gives_the_same(monkeypatch):
    pairs = random_pairs(60, 9)
    monkeypatch.setattr(chains, "MOVES", 1)
    assert solved(pairs) == [best(a, b) for a, b in pairs]
    monkeypatch.setattr(chains, "CELLS", 1)
    assert solved(pairs) == [best(a, b) for a, b in pairs]


def test_long_chains_need_a_narrow_band_only(monkeypatch):
    rnd = random.Random(3)
    a = [(rnd.randrange(10**6), 0) for _ in range(20_000)]
    b = [x for k, x in enumerate(a) if k % 5000 != 77]
    widths, solve = [], chains._Band.solve

    def noted(self):
        out = solve(self)
        widths.append((self.width, len(self.pairs.n)))
        return out

    monkeypatch.setattr(chains._Band, "solve", noted)
    assert len(solved([(a, b)])[0]) == len(b)
    assert widths == [(4 + 2 * 1 + 1, 1)]
    # nothing in common: the band grows until it holds the whole table
    widths.clear()
    assert solved([([(k, 0) for k in range(40)], [(k + 100, 0) for k in range(30)])]) == [[]]
    assert [w for w, _ in widths] == [10 + 2 * k + 1 for k in (1, 2, 4, 8, 16, 32)]


def test_steps_keys_and_words(spark):
    text = "Step 1: Price is $1,200.50\n\n 2) tax:  3% \r\n- So total = 1236.515\n* done.\nStep 4: x"
    row = spark.range(1).select(chains.steps(F.lit(text)).alias("s")).select("s", F.transform("s", chains.step_key).alias("k"), F.transform("s", chains.step_words).alias("w")).first()
    assert row.s == ["Price is $1,200.50", "tax:  3%", "So total = 1236.515", "done.", "x"]
    assert row.k[0].startswith("=") and row.k[3:] == ["done.", "x"]
    assert row.w[1:] == ["tax 3%", "so total 1236.515", "done.", "x"]
    same = spark.range(1).select(*[chains.step_key(F.lit(x)).alias(n) for n, x in (("a", "it is 5.0"), ("b", "so 5"), ("c", "that is 5,000"), ("d", "5e3"))]).first()
    assert same.a == same.b != same.c


def test_steps_that_come_to_equal_numbers_have_one_key(spark):
    forms = ["5", "05", "5.0", "005.00", "50", "0.5", "00.50", "-5.0", "-05", "0", "-0.00", "000", "5.05", "500", "0.05", "1" + "0" * 60, "1" + "0" * 60 + ".0"]
    df = spark.createDataFrame([(f"it is {x}",) for x in forms], "x string").select("x", chains.step_key(F.col("x")).alias("k"))
    keys = {r.x.removeprefix("it is "): r.k for r in df.collect()}
    for a in forms:
        for b in forms:
            assert (keys[a] == keys[b]) == (Decimal(a) == Decimal(b)), (a, b)
    assert all(k.startswith("=") for k in keys.values())
    # what makes it cheap: one regular expression a step, none of them to spell a number
    plan = spark.range(1).select(chains.step_key(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 2


def test_only_kept_columns_pass(spark):
    df = spark.createDataFrame([(1, "a = 1", "a = 1", "x")], "id int, gold_chain string, response_chain string, more string")
    assert chains.align(df, keep=["id"]).columns == ["id", *chains.RESULTS]
    assert chains.align(df, keep=["id"]).first().matched == 1


def test_align_counts_ties_and_odd_rows(spark):
    rows = [
        (1, "Step 1: a = 2\nStep 2: b = 3\nStep 3: c = 5", "Step 1: a = 2\nStep 2: we get 3.0\nnow 5\nso 5"),
        (2, "x = 1\nx = 1", "x = 1"), (3, "x = 1", "x = 1\nx = 1"), (4, None, "x = 1"), (5, "x = 1\ny", None), (6, "", " \n\n"), (7, "a = 1\nb = 2", "b = 2\na = 1"),
        (1, "Step 1: a = 2\nStep 2: b = 3\nStep 3: c = 5", "Step 1: a = 2\nStep 2: we get 3.0\nnow 5\nso 5"),
    ]
    df = spark.createDataFrame(rows, "id int, gold_chain string, response_chain string").withColumn("gold", F.lit(1)).withColumn("all", F.lit(2)).withColumn("missing", F.lit("x"))
    out = chains.align(df)
    assert out.columns == ["id", "gold_chain", "response_chain", "gold", "all", *chains.RESULTS]
    got = {r.id: (r.n_gold, r.n_response, r.matched, r.reworded, r.missing, r.extra, r.gold_places, r.response_places, r.first_missing) for r in out.collect()}
    assert got == {
        1: (3, 4, 3, 2, 0, 1, [0, 1, 2], [0, 1, 2], None), 2: (2, 1, 1, 0, 1, 0, [0], [0], 1), 3: (1, 2, 1, 0, 0, 1, [0], [0], None), 4: (0, 1, 0, 0, 0, 1, [], [], None),
        5: (2, 0, 0, 0, 2, 0, [], [], 0), 6: (0, 0, 0, 0, 0, 0, [], [], None), 7: (2, 2, 1, 0, 1, 1, [1], [0], 0),
    }
    assert out.count() == 8 and chains.align(df.limit(0)).count() == 0
    report = chains.chain_report(out).first()
    assert (report.chains, report.complete, report.missing, report.extra) == (8, 1, 4, 5) and report.step_recall == 9 / 13
    assert chains.chain_report(chains.align(df.limit(0))).first().step_recall == 0.0
    with pytest.raises(ValueError):
        chains.align(df, band=-1)
