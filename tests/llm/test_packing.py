import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quern.llm import packing, tokens
from quern.llm import wordscan as ws
from quern.llm.common import table
from tests.llm.cases import documents, odd_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def test_ids_are_the_librarys(library):
    rnd = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "é", "a", "B", "1", "23", "!", "?", "<|endoftext|>", "<|", "\xa0", "世", "🙂", "'s", "x'", "\r\n", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + [x or "" for x in odd_texts()]
    encoder, got = tokens.encoder(tokens.default_path()), []
    for _, _, at, data in ws.slices(pa.array(texts), 20_000):
        made = encoder.encode(at, data)
        got += [made.ids[a:b].tolist() for a, b in zip(made.first[:-1], made.first[1:], strict=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, library):
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert docs.keys() == texts.keys()
    for doc, pieces in docs.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = []
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        used.append(at)
    return used


def test_odd_texts(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 20_000)
    texts = [*odd_texts(), "a <|endoftext|> b", "no sentence end " * 3000]
    used = check(packing.pack(documents(spark, texts).repartition(3)).collect(), dict(enumerate(texts)), library)
    assert sum(packing.LENGTH - x for x in used if x & (x - 1)) < 0.05 * sum(used)
    assert packing.pack(documents(spark, [])).collect() == []
    both = packing.pack(documents(spark, ["same", "same"], [1, 1])).collect()
    assert [r.start for r in both] == [0, 0] and len({(r.sequence_id, r.offset) for r in both}) == 2


def test_table(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    used = check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, library)
    assert sum(packing.LENGTH - x for x in used if x & (x - 1)) < 0.02 * sum(used)


def test_cuts_are_the_cheapest():
    rnd = random.Random(4)
    for _ in range(200):
        at = np.array(sorted({0, *[rnd.randrange(1, 60) for _ in range(25)]} - {0}))
        at = np.unique(np.concatenate([at, np.arange(8, at[-1], 8)]))
        price = np.array([float(rnd.choice([0, 2, 5])) for _ in at])
        cuts = packing.best_cuts(at, price, 12)
        cost = lambda cuts: sum(12 - (b - a) for a, b in zip([0, *at[cuts][:-1]], at[cuts], strict=True)) + price[cuts].sum()
        best = {0: 0.0}
        for x, p in zip(at.tolist(), price.tolist(), strict=True):
            best[x] = min(best[i] + 12 - (x - i) for i in best if x - 12 <= i < x) + p
        assert cuts[-1] == len(at) - 1 and np.diff(np.append(0, at[cuts])).max() <= 12
        assert cost(cuts) == best[int(at[-1])]
    assert packing.powers(1500) == [1024, 256, 128, 64, 16, 8, 4] and packing.powers(0) == []
