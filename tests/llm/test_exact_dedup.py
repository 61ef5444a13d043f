import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import common, exact_dedup
from tests.llm.cases import documents, odd_texts

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(texts, ids):
    groups = defaultdict(list)
    for place, (i, t) in enumerate(zip(ids, texts, strict=True)):
        groups[(t or "").translate(BLANKS)].append((-len(t or ""), i is None, i if i is not None else 0, place, i))
    out = []
    for bare, rows in groups.items():
        best = min(rows)
        kept = [r is best for r in rows]
        out += [(r[4], best[4], len(rows), k, hashlib.sha256(bare.encode()).hexdigest()) for r, k in zip(rows, kept, strict=True)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def mixed(n=300):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab \n\té世") for _ in range(rnd.choice([0, 1, 2, 5, 80, 200]))) for _ in range(n)]
    base += [t + " " for t in rnd.sample(base, 40)] + rnd.sample(base, 40)
    head = "p" * exact_dedup.PREFIX
    base += [head + x for x in ("left", "rite", "left", "l eft")]  # equal lengths and prefixes, different ends
    return base + odd_texts()


def test_against_brute_force(spark):
    texts = mixed()
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    assert result(exact_dedup.exact_groups(documents(spark, texts, ids), ["doc_id"], digests=True)) == brute(texts, ids)


@pytest.mark.parametrize("name, value", [("LISTED", 3), ("KEY_CLASSES", 1), ("KEY_CLASSES", 64), ("HEAVY", 1), ("PREFIX", 1)])
def test_the_bounds_save_work_only(spark, monkeypatch, name, value):
    monkeypatch.setattr(common if name == "KEY_CLASSES" else exact_dedup, name, value)
    texts = mixed(80)
    assert result(exact_dedup.exact_groups(documents(spark, texts), ["doc_id"], digests=True)) == brute(texts, list(range(len(texts))))


def test_whole_texts_are_hashed_for_those_that_may_be_equal_only(spark):
    head = "p" * exact_dedup.PREFIX
    texts = ["x", "yy", head + "one", head + "two", head + "one", head + "three", "q" * exact_dedup.PREFIX + "one", None, "alone"]
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(documents(spark, texts)).collect()}
    # of one length and prefix: 2, 3, 4; the rest were told apart by length (0, 1, 5, 7, 8) or prefix (6)
    assert {i for i, r in rows.items() if r.text_sha256} == {2, 3, 4}
    assert [rows[i].group_size for i in range(9)] == [1, 1, 2, 1, 2, 1, 1, 1, 1]


def test_shared_lengths_and_heads(spark):
    rows = [(5, 10), (5, 10), (5, 11), (6, 12), (7, 13), (7, 14), (exact_dedup.LISTED, 15), (exact_dedup.LISTED, 15)]
    df = spark.createDataFrame(rows, "length int, head long")
    assert sorted(r.length for r in exact_dedup.shared_lengths(df).collect()) == [5, 7]
    assert sorted(r.key for r in exact_dedup.shared_heads(df).collect()) == [10, 15]
    keys = spark.createDataFrame([(10,), (15,), (-1,), (common.KEY_CLASSES + 70,)], "key long")
    marks = common.key_marks(keys)
    pages = {r.page: {i: x for i, x in enumerate(r.words) if x} for r in marks.collect()}
    assert pages == {0: {0: 1 << 10 | 1 << 15, 1: 1 << 6}, common.KEY_CLASSES // 64 // common.PAGE - 1: {common.PAGE - 1: -(1 << 63)}}
    asked = spark.createDataFrame([(10,), (11,), (-1,), (70,), (None,)], "k long")
    assert {r.k: r.may for r in common.with_mark(asked, F.col("k"), marks, "may").collect()} == {10: True, 11: False, -1: True, 70: True, None: False}


def test_only_marked_rows_are_those_with_a_mark(spark):
    marks = common.key_marks(spark.createDataFrame([(10,), (15,), (-1,)], "key long"))
    asked = spark.createDataFrame([(10,), (11,), (-1,), (common.KEY_CLASSES + 15,), (10,), (None,)], "k long")
    out = common.only_marked(asked, F.col("k"), marks)
    assert out.columns == ["k"] and sorted(r.k for r in out.collect()) == [-1, 10, 10, common.KEY_CLASSES + 15]


def test_nulls_ties_and_repeated_rows(spark):
    texts = ["a b", "ab ", None, "", "  ", "same", "same", "same", "n", "n"]
    ids = [7, 3, 5, 4, 9, 1, 1, 1, None, None]
    df = exact_dedup.exact_groups(documents(spark, texts, ids), ["doc_id"], digests=True)
    assert result(df) == brute(texts, ids)
    rows = df.collect()
    assert sum(r.kept for r in rows if r.doc_id == 1) == 1 and sum(r.kept for r in rows if r.doc_id is None) == 1
    assert {r.doc_id for r in rows if r.kept and r.group_size == 3 and r.doc_id != 1} == {9}  # the blank text of most characters


def test_empty_table_and_clashing_columns(spark):
    none = documents(spark, []).withColumnRenamed("f", "bare").withColumnRenamed("spans", "kept")
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.without_copies(none).count() == 0
    some = documents(spark, ["a", "a ", "b"]).withColumnRenamed("f", "bare").withColumnRenamed("spans", "kept").withColumnRenamed("count", "all")
    out = exact_dedup.exact_groups(some)
    assert out.columns == [c for c in some.columns if c != "kept"] + list(exact_dedup.RESULTS) and out.count() == 3
    left = exact_dedup.without_copies(some)
    assert left.columns == some.columns and sorted(r.text for r in left.collect()) == ["a ", "b"]


def test_a_third_of_all_rows_in_one_group(spark):
    texts = [f"text {i}" for i in range(400)] + ["the same words"] * 200
    rows = exact_dedup.exact_groups(documents(spark, texts).repartition(7), ["doc_id"]).collect()
    assert sorted(r.group_size for r in rows) == [1] * 400 + [200] * 200
    assert {r.keep_id for r in rows if r.group_size == 200} == {400}
