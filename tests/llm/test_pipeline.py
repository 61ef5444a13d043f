"""The pipeline against brute-force versions of its stages."""

import corpus_pipeline
from tests.llm import test_ngram_join, test_packing, test_secrets, test_winnowing
from tests.llm.cases import documents, odd_texts

from quern.llm import quality, secrets
from quern.llm.common import saved, table
from tokenizers import Tokenizer

from quern.llm import tokens


def redacted(text):
    at, out = 0, ""
    for a, _, b, _ in test_secrets.brute(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def steps(spark, docs, sf_dir):
    """Each stage on what the one before kept, written and read again; yields (name, input rows, output)."""
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf_dir), "test")
        yield name, docs, out
        docs = out


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = {name: (before, after) for name, before, after in steps(spark, docs, sf_dir)}
    assert list(made) == [n for n, _ in corpus_pipeline.STAGES] and len(made) == 5
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = made["quality rules"]
    assert text(after) == {r.doc_id: text(before)[r.doc_id] for r in quality.quality(before).where("kept").collect()}

    before, after = made["n-gram jaccard join"]
    known = text(before)
    assert sorted(text(after)) == sorted({c if n else d for d, n, c in test_ngram_join.brute(list(known.items()))})

    before, after = made["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert sorted(text(after)) == sorted(r[0] for r in test_winnowing.brute(list(text(before).items()), items) if not r[5])

    before, after = made["secret scans"]
    live = {r.doc_id for r in secrets.scan(before).where("spans like '%live:%'").collect()}
    got = text(after)
    assert got.keys() == text(before).keys()
    assert all(got[d] == redacted(t) for d, t in text(before).items() if d not in live)
    for _, (before, after) in list(made.items())[:-1]:
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]

    before, after = made["packing"]
    test_packing.check(after.collect(), text(before), Tokenizer.from_file(tokens.default_path()))
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in whole if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in after.collect() if r.start == 0)


def test_odd_rows(spark, sf_dir):
    texts = odd_texts() * 2 + [None]
    ids = [*range(len(odd_texts())), *range(len(odd_texts())), None]
    docs = documents(spark, texts, ids)
    for _, before, after in list(steps(spark, docs, sf_dir))[:-1]:
        assert after.columns == docs.columns
        assert after.count() <= before.count()
    none = documents(spark, [])
    assert [after.count() for _, _, after in steps(spark, none, sf_dir)] == [0] * 5


def test_one_of_each_keeps_ids_with_words_once(spark):
    from quern.llm.ngram_join import one_of_each

    a, b = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(80))
    docs = documents(spark, [a, a, a, b, a, "", None, None], [3, 3, 5, 3, None, 9, 9, None])
    out = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert out == sorted([(3, a), (3, b), (9, ""), (9, None), (None, None), (None, a)], key=str)
