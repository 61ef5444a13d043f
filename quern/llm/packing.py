"""Packing (operator 8): order-preserving dynamic programming over window cuts.

Documents stay in input order; each is its ids followed by id 1.  The stream of
a partition is cut into windows of at most 2048 ids.  Cuts may fall after a
document (free), after a sentence of it (:data:`SENTENCE`), or, so that a long
sentence never forces much padding, after every :data:`STRIDE` ids
(:data:`TRUNCATION`).  With ``dp[j]`` the least cost of packing up to cut j,

    dp[j] = penalty[j] + min over i in [j - 2048, j) of dp[i] + 2048 - (j - i)

The part that depends on i, ``dp[i] + i``, is the same for every j, so a
monotone queue of candidates gives each transition in constant time.

A partition is worked off in stretches of about :data:`STRETCH` ids; the last
windows of a stretch are opened again with the next one, so memory is bounded
and only the end of a partition has a rest.  That rest is cut into powers of
two, which need no padding.  Nothing is shuffled; a lost task is done again
from its own input split with the same result, as sequence ids are made of the
partition's number and a counter.

Defined results: a null or empty text is a document of the one id 1.  Repeated
rows are packed like others.  An empty table gives no rows.  Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm import wordscan as ws

LENGTH = 2048
END_ID = 1
SENTENCE, TRUNCATION, STRIDE = 8.0, 64.0, 64
STRETCH = 1_000_000
_OPEN = 16


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH, free_rest: bool = False) -> list[int]:
    """Indices into `at` (increasing positions after 0, gaps of at most `length`) of the cheapest cuts; the last position is always cut.

    free_rest: the last window costs nothing, as it is cut into powers of two, or opened again with the next stretch.
    """
    where, cost = at.tolist(), penalty.tolist()
    done, back = [0.0] * len(where), [-1] * len(where)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # (dp + position, position, index)
    for j, (x, p) in enumerate(zip(where, cost, strict=True)):
        least = x - length
        while queue[0][1] < least:
            queue.popleft()
        value, _, i = queue[0]
        back[j] = i
        value = value + length - x + p
        done[j] = value
        value += x
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, x, j))
    if free_rest and where[-1] <= length:
        return [len(where) - 1]
    if free_rest:
        back[-1] = min((i for i in range(len(where) - 1) if where[i] >= where[-1] - length), key=lambda i: (done[i], i))
    out = []
    j = len(where) - 1
    while j >= 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what that costs. ends: positions after each document."""
    price = np.full(len(ids) + 1, np.inf)
    price[STRIDE::STRIDE] = TRUNCATION
    price[1:][stops[ids]] = SENTENCE
    price[ends] = 0
    price[0] = np.inf
    price[-1] = min(price[-1], TRUNCATION)
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def powers(rest: int) -> list[int]:
    """Lengths that are powers of two and sum to `rest`, longest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Stream:
    """Documents that are not yet in closed windows."""

    def __init__(self, base: int):
        self.sequence = base
        self.ids = np.zeros(0, np.uint32)
        self.doc: list = []  # doc_id, its whole length, ids of it before this stream's first id
        self.size = np.zeros(0, np.int64)  # ids of each document in this stream

    def add(self, ids: np.ndarray, docs: list, sizes: np.ndarray) -> None:
        self.ids = np.append(self.ids, ids)
        self.doc += [(d, n, 0) for d, n in zip(docs, sizes.tolist(), strict=True)]
        self.size = np.append(self.size, sizes)

    def close(self, stops: np.ndarray, last: bool) -> Iterator[tuple]:
        """Pieces of the windows that are final now."""
        if not len(self.ids):
            return
        ends = np.cumsum(self.size)
        at, price = candidate_cuts(self.ids, ends, stops)
        cuts = at[best_cuts(at, price, free_rest=True)]
        if last:
            begin = int(cuts[-2]) if len(cuts) > 1 else 0
            cuts = np.append(cuts[:-1], begin + np.cumsum(powers(int(cuts[-1]) - begin)))
        elif len(cuts) > _OPEN:
            cuts = cuts[:-_OPEN]
        else:
            return
        begins = np.append(0, ends[:-1])
        first = np.append(0, cuts[:-1])
        borders = np.unique(np.concatenate([first, begins[begins < cuts[-1]]]))
        stop = np.append(borders[1:], cuts[-1])
        doc = np.searchsorted(begins, borders, side="right") - 1
        window = np.searchsorted(first, borders, side="right") - 1
        for a, b, d, w in zip(borders.tolist(), stop.tolist(), doc.tolist(), window.tolist(), strict=True):
            doc_id, whole, before = self.doc[d]
            yield doc_id, before + a - int(begins[d]), b - a, zlib.crc32(self.ids[a:b].astype("<u4").tobytes()), whole, self.sequence + w, a - int(first[w])
        self.sequence += len(cuts)
        cut = int(cuts[-1])
        gone = int(np.searchsorted(ends, cut, side="right"))
        self.ids = self.ids[cut:]
        self.doc, self.size = self.doc[gone:], self.size[gone:].copy()
        if self.doc:
            part = cut - int(begins[gone])
            if part > 0:
                doc_id, whole, before = self.doc[0]
                self.doc[0] = (doc_id, whole, before + part)
                self.size[0] -= part


def _packed(path: str):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        stream = _Stream(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for lo, hi, at, data in ws.slices(batch.column("text"), tokens.SLICE):
                made = encoder.encode(at, data)
                sizes = np.diff(made.first)
                ids = np.insert(made.ids, made.first[1:], END_ID)
                stream.add(ids, batch.column("doc_id").slice(lo, hi - lo).to_pylist(), sizes + 1)
                if len(stream.ids) >= STRETCH and (rows := list(stream.close(encoder.stops, last=False))):
                    yield batch_of(rows)
        if rows := list(stream.close(encoder.stops, last=True)):
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_packed(path or tokens.default_path()), _SCHEMA)
