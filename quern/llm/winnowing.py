"""Benchmark decontamination (operator 9) by winnowing.

Every run of :data:`GRAM` words is hashed, and of every :data:`WINDOW`
neighbouring hashes the least is kept as a fingerprint, in documents as in
benchmark items (of equals the one kept before, else the rightmost).  A span of
``GRAM + WINDOW - 1`` = 10 words that a document shares with an item holds one
whole selection window, both sides keep the same hash of it, and so the join of
fingerprints cannot miss it.  Joined fingerprints are extended to every 10-word
window around them; each such window of the document is looked up once among
the distinct windows of the benchmark and compared word by word.  A distinct
window knows the set of items that have it, and equal sets are kept once, so
text that repeats in documents, in items or among items costs no more than
other text.  An item of fewer words is one window; for those, each run of that
many words is its own fingerprint (winnowing with a window of one).

The benchmark is the small side.  Its size is measured first: up to
:data:`BLOCK_CHARS` characters go to the executors as one broadcast index.  A
larger benchmark is cut into blocks of that size by hash, documents are written
once with a row number, each block makes one pass over them, and the hits of a
row are united; nothing is left out and nothing broadcast grows.  Items that
repeat are one before they are dealt out.

Defined results: null text or text without words has no words, no hits and no
items.  Items without words are ignored.  Items that share an id count once.
An item whose id is null marks words but is not counted.  Repeated documents
each get a row.  `items_sha256` of no items is the hash of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import wordscan as ws
from quern.llm.common import discard, saved

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
BLOCK_CHARS = 8_000_000


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions that windows of WINDOW hashes keep, in order: of a window its least, of equals the rightmost.

    Where one least hash lasts for more than WINDOW windows, which takes equals, a window keeps what the one before kept if it can.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, low = np.arange(n), hashes[:n].copy()
    for j in range(1, WINDOW):
        other = hashes[j : n + j]
        better = other <= low
        low[better] = other[better]
        at[better] = np.flatnonzero(better) + j
    start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    length = np.diff(np.append(start, n))
    lasting = length > WINDOW
    kept = [at[~np.repeat(lasting, length)]]
    for a, b in zip(start[lasting].tolist(), (start + length)[lasting].tolist(), strict=True):
        run, window = [], a
        while window < b:
            run.append(int(at[window]))
            window = run[-1] + 1
        kept.append(np.array(run))
    return np.unique(np.concatenate(kept))


class Windows:
    """Distinct windows of one length and the sets of items that have them."""

    def __init__(self, keys: np.ndarray, where: np.ndarray, item: np.ndarray):
        """Of each window: its hash, its place in the words of the benchmark, its item."""
        order = np.lexsort((item, keys))
        keys, where, item = keys[order], where[order], item[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])) if len(keys) else np.zeros(0, bool)
        keys, where, item = keys[new], where[new], item[new]
        self.first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.where = keys[self.first], where[self.first]
        size = np.diff(np.append(self.first, len(keys)))
        # a name for each set; equal sets have equal names
        name = np.add.reduceat(ws.mix(item.astype(np.uint64) + np.uint64(1)), self.first) + size.astype(np.uint64) if len(keys) else keys
        _, one, self.set = np.unique(name, return_index=True, return_inverse=True)
        self.size = size[one]
        self.at = np.cumsum(self.size) - self.size
        self.items = item[np.repeat(self.first[one] - self.at, self.size) + np.arange(int(self.size.sum()))]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `hashes` are known, the window of each of these)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        known = np.flatnonzero(self.keys[at] == hashes)
        return known, at[known]

    def pairs(self, doc: np.ndarray, window: np.ndarray) -> np.ndarray:
        """(document, item) for each distinct pair of a document and a set."""
        both = np.unique(doc * (len(self.size) + 1) + self.set[window]) if len(doc) else np.zeros(0, np.int64)
        doc, which = both // (len(self.size) + 1), both % (len(self.size) + 1)
        times = self.size[which]
        item = self.items[np.repeat(self.at[which] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        return np.stack([np.repeat(doc, times), item], 1)


class Index:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        column = pa.array(texts, pa.string())
        self.ids = ids
        words, first = [np.zeros(0, np.uint64)], [0]
        for _, _, offsets, data in ws.slices(column):
            w = ws.scan(offsets, data, ws.ALNUM)
            words.append(w.hash)
            first += (w.first[1:] + first[-1]).tolist()
        self.words, first = np.concatenate(words), np.array(first, np.int64)
        size = np.diff(first)
        long = np.flatnonzero(size >= SPAN)
        number = size[long] - SPAN + 1
        where = np.repeat(first[long] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        self.long = Windows(ws.grams(self.words, SPAN)[where], where, np.repeat(long, number))
        least = ws.grams(self.words, GRAM)
        self.prints = np.unique(np.concatenate([np.zeros(0, np.uint64), *[(g := least[first[i] : first[i + 1] - GRAM + 1])[winnowed(g)] for i in long]]))
        self.short = {}
        for m in np.unique(size[(size > 0) & (size < SPAN)]).tolist():
            item = np.flatnonzero(size == m)
            self.short[m] = Windows(ws.grams(self.words, m)[first[item]], first[item], item)

    def hits(self, words: ws.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flags of hit words, documents, items): the last two are the distinct pairs that share a window."""
        hashes, first = words.hash, words.first
        n = len(hashes)
        edge = np.zeros(n + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        end = np.repeat(first[1:], np.diff(first))

        def mark(known: Windows, start: np.ndarray, size: int) -> None:
            """`start`: distinct places of windows that lie in one document."""
            grams = ws.grams(hashes, size)
            found, window = known.find(grams[start])
            start = start[found]
            for j in range(size):
                same = hashes[start + j] == self.words[known.where[window] + j]
                start, window = start[same], window[same]
            edge[start] += 1
            edge[start + size] -= 1
            pairs.append(known.pairs(np.searchsorted(first, start, side="right") - 1, window))

        if n >= SPAN and len(self.prints):
            grams = ws.grams(hashes, GRAM)
            kept = winnowed(grams)
            at = np.searchsorted(self.prints, grams[kept])
            at[at == len(self.prints)] = 0
            kept = kept[self.prints[at] == grams[kept]]
            start = np.unique((kept[:, None] - np.arange(WINDOW)[None, :]).ravel())
            start = start[(start >= 0) & (start + SPAN <= n)]
            mark(self.long, start[start + SPAN <= end[start]], SPAN)
        for m, known in self.short.items():
            if n >= m:
                start = np.arange(n - m + 1)
                mark(known, start[start + m <= end[start]], m)
        found = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(edge[:-1]) > 0, found[:, 0], found[:, 1]


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_KEY = "doc_id long"
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            for lo, hi, at, data in ws.slices(batch.column("text"), 1_000_000):
                words = ws.scan(at, data, ws.ALNUM)
                hit, doc, item = known.hits(words)
                n_words = np.diff(words.first)
                n_hit = np.diff(np.append(0, np.cumsum(hit))[words.first])
                ids: list[list[str]] = [[] for _ in range(hi - lo)]
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    if known.ids[i] is not None:
                        ids[d].append(known.ids[i])
                ids = [sorted(set(x)) for x in ids]
                runs = [[] for _ in range(hi - lo)]
                if hit.any():
                    step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                    owner = np.repeat(np.arange(hi - lo), n_words)
                    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                        while a < b:  # a run of flags may go on into the next document
                            stop = min(b, words.first[owner[a] + 1])
                            runs[owner[a]].append((int(a - words.first[owner[a]]), int(stop - words.first[owner[a]])))
                            a = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                        pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    ],
                    names=["row", "doc_id", "n_words", "n_hit", "items", "runs"],
                )

    return run


_FOUND = "row long, doc_id long, n_words long, n_hit long, items array<string>, runs array<struct<a: bigint, b: bigint>>"


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[DataFrame]:
    """The different items of the benchmark in parts of about `block_chars` characters, dealt by hash; one part at least."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    if blocks == 1:
        return iter([items])
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    items = saved(items.withColumn("part", part).repartition(blocks, "part"), "items")
    return (items.where(F.col("part") == b).drop("part") for b in range(blocks))


def _broadcast(block: DataFrame):
    rows = block.collect()
    return block.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows]))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row, doc_id, n_words, n_hit, items (sorted ids), runs (word ranges that are hit) for every row of `docs`.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = list(benchmark_blocks(benchmark, block_chars))
    if len(blocks) == 1:
        return docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text").mapInArrow(_search(_broadcast(blocks[0])), _FOUND)
    docs = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "documents")
    found = [saved(docs.mapInArrow(_search(_broadcast(b)), _FOUND), "hits") for b in blocks]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
    )
    # runs in order of their start: each adds what lies beyond the furthest end so far
    n_hit = F.aggregate(
        "runs", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, r: F.struct(F.greatest(acc.end, r.b).alias("end"), (acc.n + F.greatest(F.lit(0).cast("long"), r.b - F.greatest(acc.end, r.a))).alias("n")),
        lambda acc: acc.n,
    )
    return every.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "items", "runs")


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`."""
    found = contaminated_spans(docs, benchmark, block_chars)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            keep = []
            for _, _, at, data in ws.slices(batch.column("text"), 1_000_000):
                words = ws.scan(at, data, ws.ALNUM)
                hit, _, _ = known.hits(words)
                keep.append(np.diff(np.append(0, np.cumsum(hit))[words.first]) == 0)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` that share no window with the benchmark, all columns kept.

    Of several benchmark blocks each makes a pass over what the ones before have left, which is written in between: a stage
    runs one Python worker and holds one block.
    """
    blocks = list(benchmark_blocks(benchmark, block_chars))
    schema, before = docs.schema, None
    for place, block in enumerate(blocks):
        docs = docs.mapInArrow(_clean(_broadcast(block)), schema)
        if place < len(blocks) - 1:
            docs = saved(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs
