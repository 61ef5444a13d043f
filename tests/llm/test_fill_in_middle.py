import hashlib
import random

import numpy as np
import regex
from pyspark.sql import functions as F

from quern.llm import fill_in_middle as fim
from tests.llm.cases import documents, odd_texts

UNITS = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def cases():
    rnd = random.Random(8)
    parts = ["a", "<", "<P", "<S>", ">", "P>", " ", "\n", "\x0b", "é", "世", "🙂", "\x00", "\xa0", "<M>", "word", "  "]
    return odd_texts() + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(600)] + ["x <P> y", "<M>", " ", "\n\n", "a", " a", "a ", "<S", "M> <P"]


def test_against_brute_force(spark):
    texts = cases()
    ids = [i * 37 - 500 for i in range(len(texts))]
    got = [tuple(r) for r in fim.digests(documents(spark, texts, ids)).collect()]
    assert sorted(got) == sorted(brute(i, t) for i, t in zip(ids, texts, strict=True))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_borders_are_those_of_the_pattern():
    for text in cases():
        ends = np.cumsum([0] + [len(u) for u in UNITS.findall(text or "")])
        assert fim.borders(fim.code_points(text or "")).tolist() == ends.tolist()


def test_round_trip_of_each_form_and_pieces_that_begin_marks(spark):
    texts = ["<P a <S b <M c > d", "<< <P< <S P> M>", "one two three", "🙂 é\n\n世 ", "<"] * 40
    for rate, share in ((100, 0), (100, 100), (0, 0)):
        out = fim.transform(documents(spark, texts), rate=rate, suffix_first=share)
        rows = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert {r.form for r in rows} == {"plain" if not rate else "spm" if share else "psm"}
        assert all(r.back == r.text for r in rows) and all(r.output == r.text for r in rows if r.form == "plain")


def test_null_ids_repeated_rows_empty_table_and_clashing_columns(spark):
    docs = documents(spark, ["a b c", "a b c", None, ""], [None, None, 1, 2]).withColumnRenamed("f", "h0").withColumnRenamed("spans", "output").withColumnRenamed("count", "all")
    out = fim.transform(docs, rate=100)
    assert out.columns == [c for c in docs.columns if c != "output"] + ["units", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.collect()
    same = [tuple(r) for r in rows if r.doc_id is None]
    assert same[0][-5:] == same[1][-5:] and same[0][-4] != "plain"
    assert all(r.form == "plain" and r.output == "" and r.units == 0 for r in rows if r.doc_id is not None)
    assert fim.transform(documents(spark, [])).count() == 0 and fim.digests(documents(spark, [])).count() == 0


def test_the_same_at_any_partitioning_and_another_at_another_seed(spark):
    docs = documents(spark, [f"one two three {i} five six" for i in range(200)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(fim.digests(docs.repartition(1))) == rows(fim.digests(docs.repartition(9)))
    assert rows(fim.digests(docs)) != rows(fim.digests(docs, seed=43))
