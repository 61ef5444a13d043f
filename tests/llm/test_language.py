import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import language as g
from quern.llm import tokens
from quern.llm import wordscan as ws
from quern.llm.common import table
from tests.llm.cases import documents, odd_texts


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = {r.doc_id: r for r in docs.collect()}
    out = g.identify(docs).collect()
    assert len(out) == len(known)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id].lang for r in held) >= 0.97 * len(held)


def word_logs(text, model, pieces):
    """By a table over all positions of each word, with logarithms."""
    out = np.zeros(len(model.languages))
    number = {x: i for i, x in enumerate(pieces)}
    most = max(map(len, pieces))
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        word = b" " + word.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        for k in range(len(out)):
            log = [0.0]
            for end in range(1, len(word) + 1):
                parts = [log[end - n] + math.log(model.p[number[word[end - n : end]], k]) for n in range(1, min(end, most) + 1) if word[end - n : end] in number]
                top = max(parts)
                log.append(top + math.log(sum(math.exp(x - top) for x in parts)))
            out[k] += log[-1]
    return out


@pytest.fixture(scope="module")
def pieces():
    return g.vocabulary(tokens.default_path())


@pytest.fixture(scope="module")
def model():
    texts = ["the cat sat on the mat telecommunications responsibilities", "le chat est sur le tapis", "été en forêt internationalement", "x" * 300]
    return g.fit(texts, ["en", "fr", "fr", "en"], tokens.default_path())


LONG = ["responsibilities", "telecommunicationsresponsibilitiesinternationalization" * 2, "été" * 200, "a" * 3000, "世界は広い" * 90, "q"]


def test_forward_is_the_sum_over_all_segmentations_of_whole_words(model, pieces):
    assert len(pieces) > 50_000 and model.pieces.reach >= 13 and model.pieces.count == len(pieces)
    assert any(len(x) >= 13 and x.isalpha() for x in pieces)
    texts = ["The mat", "chat été", "q", "", *LONG, " ".join(LONG)]
    at, data = ws.text_buffers(pa.array(texts))
    got = g.Scorer(model).texts(at, data)
    assert np.allclose(got, [word_logs(t, model, pieces) for t in texts])
    assert np.allclose(model.p.sum(axis=0), 1)


@pytest.mark.parametrize("name, value", [("STRETCH", 50), ("STRETCH", 20), ("CELLS", 64), ("CACHE", 1), ("SLICE", 100)])
def test_stretches_groups_and_cache_change_nothing(model, pieces, monkeypatch, name, value):
    at, data = ws.text_buffers(pa.array(LONG))
    want = g.Scorer(model).texts(at, data)
    monkeypatch.setattr(g, name, max(value, model.pieces.reach + 1) if name == "STRETCH" else value)
    assert np.allclose(g.Scorer(model).texts(at, data), want)


def test_expected_counts_are_those_of_all_segmentations(model, pieces):
    """Against the slope of the log probability: a piece's expected count is its probability times that."""
    word = np.frombuffer(b" responsibilitieschatchat", np.uint8)[None]
    lattice = g.Lattice(model.pieces, word, np.array([word.shape[1]]))
    made = lattice.expected(np.log(model.p), np.ones((1, 2)))
    whole = lattice.total(lattice.forward(np.log(model.p)))
    for piece in (b"ch", b"at", b"chat", b" respons", b"e", b"s"):
        i = pieces.index(piece)
        p = model.p.copy()
        p[i] *= 1 + 1e-6
        assert np.allclose((lattice.total(lattice.forward(np.log(p))) - whole)[0] / 1e-6, made[i], atol=1e-4)


def test_a_worker_keeps_one_scorer(model):
    one = g._scorer(model)
    other = g.Model(model.languages, model.pieces, model.p)
    assert g._scorer(model) is one and g._scorer(other) is not one and len(g._last) == 1


def test_odd_texts(spark, sf_dir):
    texts = odd_texts() + ["12345 !!!", "— … “”", "世界", "éé", "a" * 100_000]
    train = table(spark, sf_dir, "documents").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    odd = documents(spark, texts, [10_000 + 4 * k for k in range(len(texts) - 1)] + [None])
    both = train.unionByName(odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"))
    out = {r.doc_id: r for r in g.identify(both).collect() if r.doc_id is None or r.doc_id >= 10_000}
    langs = {r.lang for r in train.select("lang").distinct().collect()}
    for k, x in enumerate(texts):
        r = out[10_000 + 4 * k if k < len(texts) - 1 else None]
        letters = x is not None and any(c.isalpha() for c in x)
        assert (r.lang_pred in langs) if letters else (r.lang_pred == "und" and r.score == 0)
    assert out[None].held_out is False


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["some text", None]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in g.identify(docs).collect()} == {("und", 0.0)}
    assert g.identify(docs.limit(0)).collect() == []


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    """A third of all rows share an id and a text, others share an id only."""
    rows = [(1, "same text", "en")] * 500 + [(4, f"text {k}", "en") for k in range(500)] + [(k, f"le texte {k}", "fr") for k in range(0, 800)] + [(3, "x" * (g.TEXT_BYTES + 1), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    made = g.training_rows(docs, sample=20)
    assert len(made) == len(set(made)) and {lang for lang, _ in made} == {"en", "fr"}
    assert all(sum(x == lang for x, _ in made) <= 20 for lang in ("en", "fr"))
    few = g.training_rows(docs, sample=20, sample_bytes=60)
    assert 0 < len(few) and all(sum(len(t) for x, t in few if x == lang) <= 60 for lang in ("en", "fr"))
    assert made == g.training_rows(docs.repartition(2), sample=20)
    assert sorted({r.lang_pred for r in g.identify(docs, sample=20).collect()}) == ["en", "fr"]


def test_of_equal_languages_the_first_by_name(spark):
    rows = [(k, "one and the same text", lang) for k in (1, 3, 4, 5) for lang in ("zz", "aa", "mm")]
    out = g.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"aa"} and all(abs(r.score - 1 / 3) < 1e-9 for r in out)


def test_fit_raises_the_likelihood():
    texts = ["the cat sat on the mat and the dog", "le chat est sur le tapis et le chien", "été en forêt avec les chats"]
    langs = ["en", "fr", "fr"]
    total = []
    for rounds in (1, 2, 4, 8):
        model = g.fit(texts, langs, tokens.default_path(), rounds)
        at, data = ws.text_buffers(pa.array(texts))
        log = g.Scorer(model).texts(at, data)
        total.append(sum(log[k, model.languages.index(x)] for k, x in enumerate(langs)))
    assert total == sorted(total)
