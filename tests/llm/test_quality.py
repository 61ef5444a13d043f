import random
import re
from collections import Counter

import pytest

from quern.llm import quality as q
from quern.llm.common import table
from tests.llm.cases import documents, odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def counts(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect()]


def test_counts_of_odd_texts(spark):
    texts = odd_texts()
    got = counts(q.quality(documents(spark, texts)))
    assert sorted(got) == [(i, brute(t)) for i, t in enumerate(texts)]


def test_counts_and_labels_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = q.quality(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(brute(texts[i]) == c for i, c in counts(out))
    judged = {r.doc_id: r for r in out.collect()}
    labels = table(spark, sf_dir, "labels").collect()
    fair = [(r.quality, judged[r.doc_id].kept) for r in labels if r.doc_id in judged and not judged[r.doc_id].base_failed]
    assert sum(k for l, k in fair if l) >= 0.99 * sum(1 for l, _ in fair if l)
    assert sum(k for l, k in fair if not l) <= 0.02 * sum(1 for l, _ in fair if not l)
    assert all(not r.kept for r in judged.values() if r.base_failed)


def plain_em(rows, rounds):
    """The same model row by row: votes are dictionaries, chances are kept per class and vote."""
    good, strength = q.PRIOR_GOOD, q.STRENGTH
    rules = range(len(rows[0]))
    right = [list(q.PRIOR_ACCURACY) for _ in rules]
    for _ in range(rounds):
        share, hit, cast = strength * q.PRIOR_GOOD, [[strength * x for x in q.PRIOR_ACCURACY] for _ in rules], [[strength, strength] for _ in rules]
        for row in rows:
            a, b = good, 1 - good
            for j in rules:
                if row[j] is not None:
                    a *= right[j][0] if row[j] else 1 - right[j][0]
                    b *= 1 - right[j][1] if row[j] else right[j][1]
            p = a / (a + b)
            share += p
            for j in rules:
                if row[j] is not None:
                    hit[j][0] += p * (row[j] == 1)
                    hit[j][1] += (1 - p) * (row[j] == 0)
                    cast[j][0] += p
                    cast[j][1] += 1 - p
        good = share / (len(rows) + strength)
        right = [[h[0] / c[0], h[1] / c[1]] for h, c in zip(hit, cast, strict=True)]
    return good, right


def votes_of(rnd, n, accuracy, good=0.8, abstain=0.3):
    truth = [rnd.random() < good for _ in range(n)]
    return truth, [tuple(None if rnd.random() < abstain else int(y == (rnd.random() < a[not y])) for a in accuracy) for y in truth]


ACCURACY = [(0.95, 0.9), (0.9, 0.85), (0.97, 0.7), (0.8, 0.6), (0.55, 0.5)]


def test_fit_is_expectation_maximisation():
    rnd = random.Random(4)
    truth, rows = votes_of(rnd, 3000, ACCURACY)
    model = q.fit(sorted(Counter(rows).items(), key=str))
    good, right = plain_em(rows, len(model.trace) - 1)
    assert model.good == pytest.approx(good, abs=1e-6)
    assert [list(x) for x in model.right] == [pytest.approx(x, abs=1e-6) for x in right]
    assert all(a <= b + 1e-6 for a, b in zip(model.trace, model.trace[1:], strict=False))  # the likelihood never falls
    assert model.good == pytest.approx(0.8, abs=0.05)  # and what was planted comes back
    assert all(abs(a - b) < 0.1 for x, y in zip(model.right[:3], ACCURACY, strict=False) for a, b in zip(x, y, strict=True))
    by_model = sum((q.probability(model, r) >= 0.5) == y for r, y in zip(rows, truth, strict=True))
    by_all_must_pass = sum((0 not in r) == y for r, y in zip(rows, truth, strict=True))
    assert by_model > by_all_must_pass + 300


@pytest.mark.parametrize("times", [1, 1000])
def test_a_vote_weighs_what_the_others_bear_out(times):
    # rules 0 to 2 speak against the same texts, rule 3 against others that these three vouch for
    patterns = [((1, 1, 1, 1), 830 * times), ((0, 0, 0, 1), 90 * times), ((1, 1, 1, 0), 80 * times)]
    model = q.fit(patterns)
    assert q.probability(model, (0, 0, 0, 1)) < 0.5 < q.probability(model, (1, 1, 1, 0))
    assert model.right[3][0] < model.right[0][0] and model.good == pytest.approx(0.9, abs=0.03)


def test_one_gainsaid_vote_rejects_nothing(spark):
    rnd = random.Random(1)
    sentence = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta kappa lambda sigma omega".split()) + rnd.choice("abcdefgh") for _ in range(n)) + "."
    fine = ["\n".join(sentence(25) for _ in range(5)) for _ in range(60)]
    short_lines = ["\n".join(sentence(6) for _ in range(20)) for _ in range(4)]
    junk = [" ".join(w + "%%%" for w in sentence(90).split()) for _ in range(6)]
    rows = q.quality(documents(spark, fine + short_lines + junk)).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True] * 64 + [False] * 6
    assert all(r.n_bad_votes == 1 for r in rows[60:64])  # all-must-pass would reject these


def test_nothing_to_fit_on():
    model = q.fit([])
    assert model.good == pytest.approx(q.PRIOR_GOOD) and len(model.right) == len(q.RULES)
    none = (None,) * len(q.RULES)
    assert q.probability(model, none) == pytest.approx(q.PRIOR_GOOD) and q.probability(model, (0, *none[1:])) < 0.5


def test_the_prior_is_weak():
    model = q.fit([((1, 1, 1), 9000), ((0, 0, 0), 1000)])
    assert model.good == pytest.approx(0.9, abs=0.001) and all(abs(x - 1) < 0.01 for r in model.right for x in r)


def test_empty_table_and_filter(spark):
    none = documents(spark, [])
    assert q.quality(none).collect() == []
    assert q.quality_filter(none).columns == none.columns
    docs = documents(spark, odd_texts() * 2)
    kept = q.quality_filter(docs)
    assert kept.schema == docs.schema
    verdict = [r.kept for r in q.quality(docs).orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, k in enumerate(verdict) if k]


def test_no_python_on_the_plan(spark, sf_dir):
    plan = q.quality(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
