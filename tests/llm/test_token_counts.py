import random
from collections import Counter

from tokenizers import Tokenizer

from quern.llm import token_counts as t
from quern.llm import tokens
from quern.llm.common import table
from tests.llm.cases import documents, odd_texts


def brute(library, values):
    """(field number, section, start, end) -> tokens, by the library's own offsets."""
    whole = "\n".join(v or "" for v in values)
    sections, at = [], 0
    for k, v in enumerate(values):
        v = v or ""
        starts = [0] + [i + 1 for i, c in enumerate(v) if c == "\n" and i + 1 < len(v)]
        sections += [(k, n, at, a, b) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(v)], strict=True))]
        at += len(v) + 1
    owner, sure = {}, []
    for place, (_, _, base, a, b) in enumerate(sections):
        for i in range(base + a, base + b):
            owner[i] = place
    for i in range(len(whole)):
        owner.setdefault(i, max(p for p, s in enumerate(sections) if s[2] + s[3] <= i))  # a line break between fields goes with the field that it ends
    seen = Counter()
    made = library.encode(whole, add_special_tokens=False)
    covered = -1
    for a, b in made.offsets:
        own = [i for i in range(a, b) if i > covered] or [a]
        covered = max(covered, b - 1)
        times = Counter(owner[i] for i in own)
        seen[min(times, key=lambda p: (-times[p], p))] += 1
        sure.append(b - a)
    return [(k, n, a, b, seen[p], len(made.ids)) for p, (k, n, _, a, b) in enumerate(sections)]


def check(spark, docs, fields, values):
    library = Tokenizer.from_file(tokens.default_path())
    out = t.token_counts(docs, fields).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((fields.index(r.field), r.section, r.start, r.end, r.n_tokens, r.doc_tokens))
    for doc, v in values.items():
        assert sorted(got.pop(doc)) == brute(library, v), doc
    assert not got


def test_odd_texts(spark):
    rnd = random.Random(1)
    parts = ["\n", "\n\n", " \n ", "é", "🙂", "ab", " c", ".", "世界", "\t\n", "<|endoftext|>"]
    texts = [*odd_texts()[:18], *["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14))) for _ in range(300)]]
    docs = documents(spark, texts)
    check(spark, docs, ("text",), {k: [x] for k, x in enumerate(texts)})
    check(spark, docs, ("source", "text", "lang"), {r.doc_id: [r.source, r.text, r.lang] for r in docs.collect()})
    assert t.token_counts(documents(spark, [])).collect() == []


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars < 4000")
    check(spark, docs, ("source", "text"), {r.doc_id: [r.source, r.text] for r in docs.collect()})
