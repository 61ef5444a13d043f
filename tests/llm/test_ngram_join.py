import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import ngram_join as j
from quern.llm.common import table
from quern.llm.graph import components
from tests.llm.cases import documents, odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    x = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for k in holders[g]:
                shared[k] += 1
            holders[g].append(i)
        for k, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[k]) - n):
                parent[find(i)] = find(k)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(j.jaccard_components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def chain():
    """Variants of one text in steps: neighbours link, ends do not; a passage that all share; and many copies."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    out, now = [], list(base)
    for k in range(40):
        now = list(now)
        now[(k * 7) % 150] = f"v{k}"
        out.append(" ".join(now))
    passage = " ".join(f"p{k}" for k in range(60))
    out += [passage + " " + " ".join(f"u{k}x{i}" for i in range(90)) for k in range(40)]
    return out + [" ".join(base)] * 30


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_and_chains(spark, monkeypatch, small):
    if small:  # blocks of a few sets, few holders: every path of the large groups
        monkeypatch.setattr(j, "BLOCK_DOCS", 7)
        monkeypatch.setattr(j, "PART_DOCS", 9)
        monkeypatch.setattr(j, "FLUSH_BYTES", 3000)
        monkeypatch.setattr(j, "HOT", 2)
    texts = odd_texts() + chain()
    ids = list(range(len(texts)))
    ids[3], ids[4], ids[8], ids[20] = None, 5, 5, 8
    assert got(j.jaccard_components(documents(spark, texts, ids).repartition(3))) == brute(list(zip(ids, texts, strict=True)))


def test_null_and_shared_ids(spark):
    """Many different texts without an id, or with one id, and among them pairs that link."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(120)]
    texts += [t + " more words" for t in texts[:60]] + texts[:10]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(texts))]
    assert got(j.jaccard_components(documents(spark, texts, ids).repartition(4))) == brute(list(zip(ids, texts, strict=True)))


def near_copies(n):
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    out = []
    for k in range(n):
        now = list(base)
        now[rnd.randrange(200)] = f"v{k}"
        out.append(" ".join(now))
    return out


def test_a_group_of_near_copies_sends_its_sets_once(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_DOCS", 10)
    sent = []

    def counted(*given, part=j._own_blocks):
        out = part(*given)
        sent.append(out.count())
        return out

    monkeypatch.setattr(j, "_own_blocks", counted)
    monkeypatch.setattr(j, "_left_over", None)  # nothing is left over
    out = j.jaccard_components(documents(spark, near_copies(200))).select("component_id").distinct().collect()
    assert [r.component_id for r in out] == [0]
    assert len(sent) == 1 and 200 <= sent[0] < 200 + 25  # its hub goes to every block, the others to one


def test_texts_that_share_a_passage_only_are_not_multiplied(spark, monkeypatch):
    """Candidates by half of their shingles, a few of which link: what is dealt to the products grows with the number of texts."""
    monkeypatch.setattr(j, "BLOCK_DOCS", 10)
    monkeypatch.setattr(j, "PART_DOCS", 20)
    sent = []

    def counted(*given, part=j._left_over):
        out = part(*given)
        sent.append((out[0] if isinstance(out, tuple) else out).count())
        return out

    monkeypatch.setattr(j, "_left_over", counted)
    passage = " ".join(f"p{k}" for k in range(28))
    texts = [passage + " " + " ".join(f"u{k}x{i}" for i in range(20)) for k in range(300)]
    texts += [t + f" end{k}" for k, t in enumerate(texts[:10])] + near_copies(60)
    assert got(j.jaccard_components(documents(spark, texts))) == brute(list(enumerate(texts)))
    assert len(sent) == 1 and sent[0] < len(texts)


def rows_made(spark, since, columns):
    """Rows that joins on one of these columns have made, by the executions after the first `since`."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for k in range(since, store.executionsCount()):
        execution = store.executionsList(k, 1).head().executionId()
        nodes, values = store.planGraph(execution).allNodes(), store.executionMetrics(execution)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and any(f"[{c}#" in node.desc() for c in columns):
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("n", [100, 200])
def test_shingles_that_nothing_left_over_has_leave_no_join(spark, monkeypatch, n):
    """Near copies, and near copies of a text that shares 4/5 of theirs: the first reach the hub, the second do not and ask for a few shingles."""
    monkeypatch.setattr(j, "BLOCK_DOCS", 50)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    texts = near_copies(n)
    apart = " ".join(["far"] + [f"f{k}" for k in range(39)])
    texts += [apart + " " + " ".join(t.split(" ")[40:]) for t in near_copies(n)[: n // 40]]
    assert got(j.jaccard_components(documents(spark, texts))) == brute(list(enumerate(texts)))
    made = rows_made(spark, since, ("page", "known_page"))
    assert 0 < made < 20 * len(texts)  # of nearly 200 shingles each


def test_sets_that_share_a_key(monkeypatch):
    """Half a name may be the same by chance; here it nearly always is."""
    whole = j.class_keys

    def short(hashes, n):
        key, other = whole(hashes, n)
        return np.where(n > 0, key % np.uint64(3), key), other

    monkeypatch.setattr(j, "class_keys", short)
    texts = near_copies(12)[:6] + [" ".join(f"u{k}x{i}" for i in range(50)) for k in range(6)] + near_copies(1) * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(range(len(texts)), pa.int64())], names=["doc_id", "text", "mark"])
    mapped = pa.Table.from_batches(list(j._mapped(1, 16, 10**9)(iter([batch])))).to_pandas()
    out = j._bounded(1)(j._counted(1)((0,), mapped))
    member = out[out["class"].notna()]
    name = dict(zip(member["doc_id"], member["class"], strict=True))
    assert len(set(name.values())) == 12 and name[0] == name[12] == name[13]  # 6 near copies, 6 others; the last two repeat the first
    reach = {frozenset((int(a), int(b))) for a, b in zip(out.a.dropna(), out.b.dropna(), strict=True)}
    near = {int(name[k]) for k in range(6)}
    front = {int(name[0])}
    while more := {x for e in reach if e & front for x in e} - front:
        front |= more
    assert near <= front


def test_empty(spark):
    assert j.jaccard_components(documents(spark, [])).collect() == []
    assert got(j.jaccard_components(documents(spark, [None, ""]))) == [(0, 0, 0), (1, 0, 1)]


def test_overlaps_against_sets():
    rnd = random.Random(1)
    sets = [np.array(sorted(rnd.sample(range(300), rnd.randrange(0, 120))), np.uint64) for _ in range(60)]
    counts = j.overlaps(sets)
    assert all(counts[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist())) for a in range(60) for b in range(60) if a != b)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(5, k) for k in range(6, 30)] + [(1, 1), (300, 200)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 100 for k in range(100, 181)} | {k: 5 for k in range(5, 30)} | {200: 200, 300: 200}


def test_components_of_heavy_nodes(spark):
    rnd = random.Random(9)
    edges = [(1000, k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 60)] + [(rnd.randrange(3000, 3100), rnd.randrange(3000, 3100)) for _ in range(90)] + [(59, 2001)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("heavy", [1, 4096, 10**9])
def test_classes_of_every_weight_get_their_names(spark, monkeypatch, heavy):
    """Broadcast to their members or met in a shuffle: the same components."""
    monkeypatch.setattr(j, "HEAVY", heavy)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words)] * 60 + [" ".join([*words[:39], f"x{k}"]) for k in range(20)] + [f"some other text of its own number {k}" for k in range(20)] + [None, "", "a b"]
    out = {r.doc_id: r.component_id for r in j.jaccard_components(documents(spark, texts)).collect()}
    assert len(out) == len(texts) and {out[k] for k in range(80)} == {0} and all(out[k] == k for k in range(100, 103))
