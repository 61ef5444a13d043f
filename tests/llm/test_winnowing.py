import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import winnowing as w
from quern.llm import wordscan as ws
from quern.llm.common import table
from tests.llm.cases import documents, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    spans = {}
    for item, text in items:
        x = words(text)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if x else 0):
            spans.setdefault(tuple(x[i : i + n]), set()).add(item)
    sizes = {len(k) for k in spans}
    for doc, text in texts:
        x, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(x) - n + 1):
                if (names := spans.get(tuple(x[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= {str(k) for k in names if k is not None}
        yield doc, len(x), len(hit), len(found), w.items_digest(list(found)), len(hit) > 0


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [w.BLOCK_CHARS, 3000])
def test_table(spark, sf_dir, block):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert any(x[5] for x in want)
    assert rows(w.contamination(docs, items, block)) == want


@pytest.mark.parametrize("block", [w.BLOCK_CHARS, 400])
def test_odd_texts(spark, block):
    texts = odd_texts()
    long = words(texts[18])
    items = [(1, " ".join(long[50:90])), (2, "Five WORDS make"), (3, None), (4, "?!"), (5, "und und und und und und und und und und und"), (None, "in all"), (7, "x1"), (7, "two words"), (10, " ".join(long[70:80])), (11, " ".join(long[300:309]) + "-zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 row", "2 doc_id")
    docs = documents(spark, texts + texts[:9], list(range(len(texts))) + [100] * 9)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], items))
    assert rows(w.contamination(docs, bench, block)) == want
    clean = w.without_contaminated(docs, bench, block)
    assert clean.schema == docs.schema and clean.count() == sum(not x[5] for x in want)


def test_eight_blocks_are_eight_passes(spark, monkeypatch):
    """Written in between, columns of any name, and the same rows as one block leaves."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(30))) for k in range(40)]
    texts = [" ".join(word() for _ in range(50)) + (" " + items[k % 40][1][5:] if k % 3 == 0 else "") for k in range(120)] + [None, ""]
    docs = documents(spark, texts).withColumnRenamed("f", "part").withColumnRenamed("count", "items").withColumnRenamed("spans", "doc")
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) + 64 for _, t in items)
    assert len(list(w.benchmark_blocks(bench, size // 8 + 1))) == 8
    stages, save = [], w.saved

    def noted(df, name):
        stages.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return save(df, name)

    monkeypatch.setattr(w, "saved", noted)
    clean = w.without_contaminated(docs, bench, size // 8 + 1)
    assert stages == [0] + [1] * 7 and clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert clean.schema == docs.schema
    want = sorted(map(str, w.without_contaminated(docs, bench).collect()))
    assert sorted(map(str, clean.collect())) == want and 0 < len(want) < len(texts)


def test_an_item_that_repeats_is_one(spark):
    text = " ".join(f"p{k}" for k in range(12))
    bench = spark.range(100_000).selectExpr("7L item_id", f"'{text}' text").unionByName(spark.createDataFrame([(8, text), (None, text)], "item_id long, text string"))
    blocks = list(w.benchmark_blocks(bench, 8_000_000))
    assert len(blocks) == 1 and blocks[0].count() == 3
    docs = documents(spark, ["x " + text, "nothing of it"])
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in w.contamination(docs, bench).collect()) == [(0, 12, 2), (1, 0, 0)]
    assert [r.doc_id for r in w.without_contaminated(docs, bench).collect()] == [1]


def test_empty(spark):
    docs, none = documents(spark, odd_texts()), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in w.contamination(docs, none).collect()} == {0}
    assert w.contamination(documents(spark, []), none).collect() == []


def test_each_window_keeps_its_least():
    rnd = np.random.default_rng(3)
    for size, values in ((12, 4), (200, 3), (300, 1000), (50, 1)):
        x = rnd.integers(0, values, size).astype(np.uint64)
        kept = set(w.winnowed(x).tolist())
        for i in range(len(x) - w.WINDOW + 1):
            part = x[i : i + w.WINDOW]
            assert any(x[j] == part.min() for j in kept if i <= j < i + w.WINDOW)
    assert w.winnowed(np.array([5, 3, 9, 1, 8, 7, 6, 9, 9], np.uint64)).tolist() == [3]
    assert len(w.winnowed(np.zeros(6000, np.uint64))) == 1000  # of equals the one kept before
    assert len(ws.grams(x, 5)) == len(x) - 4


def hit_counts(index, texts):
    column = pa.array(texts, pa.string())
    out = []
    for _, _, at, data in ws.slices(column):
        found = ws.scan(at, data, ws.ALNUM)
        hit, doc, item = index.hits(found)
        out.append((np.diff(np.append(0, np.cumsum(hit))[found.first]).tolist(), sorted(zip(doc.tolist(), item.tolist(), strict=True))))
    return out


def test_repeated_text_is_linear():
    began = time.perf_counter()
    index = w.Index(["1", "2", "3"], ["und " * 5000, "oder " * 9, "und oder " * 3000])
    assert hit_counts(index, ["und " * 20_000, "oder " * 20_000, "und oder " * 10_000]) == [([20_000, 20_000, 20_000], [(0, 0), (1, 1), (2, 2)])]
    assert time.perf_counter() - began < 3


def test_a_passage_of_many_items_is_linear():
    passage = " ".join(f"p{k}" for k in range(2000))
    began = time.perf_counter()
    index = w.Index([str(k) for k in range(500)], [passage + f" own{k}" for k in range(500)])
    (counts, pairs), = hit_counts(index, ["x " + passage + " y", passage, "none of it"])
    assert counts == [2000, 2000, 0] and len(pairs) == 1000
    assert time.perf_counter() - began < 8


def test_against_brute_force_on_few_words():
    """Texts of few different words, so that windows repeat in and across texts."""
    rnd = random.Random(6)
    make = lambda n: " ".join(rnd.choice("ab") for _ in range(n))
    items = [(k, make(rnd.choice((3, 9, 10, 12, 25)))) for k in range(40)]
    texts = [(k, make(rnd.randrange(60))) for k in range(200)]
    index = w.Index([str(k) for k, _ in items], [t for _, t in items])
    (counts, pairs), = hit_counts(index, [t for _, t in texts])
    want = list(brute(texts, items))
    assert counts == [x[2] for x in want]
    assert [sum(d == k for d, _ in pairs) for k, _ in texts] == [x[3] for x in want]
