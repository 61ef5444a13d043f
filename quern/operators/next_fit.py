"""Next-fit packing of batches of any size: blocks of documents are folded apart and joined by a prefix scan.

A document joins the open row of its batch if it fits with one separator, else it
opens the next.  What a block of documents does depends on what came before only
through the fill of the open row, so a block is a map from the fill on entry to
the fill on leaving and the number of rows that it opened.  Maps are steps: they
change only where another document becomes the first that does not fit, and all
entries that open a row at the same document leave alike.  They compose, so

1. documents are numbered in order of batch and place, and cut into blocks of
   :data:`BLOCK` numbers, whatever the batches are,
2. each block gives one summary: the map of the batch that it begins with and,
   if others begin in it, the state that it leaves behind,
3. summaries are composed :data:`FAN` at a time, level by level, until so few are
   left that one task scans them; the states on entry go down the levels again,
4. each block places its documents, given its state on entry.

No task holds more than a block of documents or FAN summaries, and a batch that
holds most of all documents is spread over all tasks.  Each step groups by a
number, so a lost task is done again with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import readers, shared

BLOCK, FAN = 1 << 16, 1024


class Run:
    """Consecutive documents of one batch with lengths `n`, of at most `room` each."""

    def __init__(self, n: np.ndarray, room: int):
        self.n, self.room, self.count = n, room, len(n)
        #: lengths with a separator before each, summed
        self.upto = np.append(0, np.cumsum(n + 1))
        #: the next document that is not empty: empty ones at the start of a row take no place
        some = np.flatnonzero(n > 0)
        self.filled = np.append(some, self.count)[np.searchsorted(some, np.arange(self.count + 1))]
        start = self.upto[np.minimum(self.filled, self.count)]
        #: the first document that does not fit into a row that document i opens
        self.stop = np.searchsorted(self.upto[1:], start + 1 + room, side="right")

    def first_misfit(self, fill: np.ndarray) -> np.ndarray:
        """The document that opens a row, for each fill above 0 on entry; `count` if none does."""
        return np.searchsorted(self.upto[1:], self.room - fill, side="right")

    def openings(self, fill: int) -> list[int]:
        """Documents that open a row, given the fill on entry; a row that is empty on entry is open already."""
        at = int(self.stop[0]) if fill == 0 else int(self.first_misfit(np.array([fill]))[0])
        out = []
        while at < self.count:
            out.append(at)
            at = int(self.stop[at])
        return out

    def fill_from(self, at: int) -> int:
        """Fill at the end of the run if document `at` opens the last row."""
        z = int(self.filled[at])
        return 0 if z == self.count else int(self.upto[-1] - self.upto[z]) - 1

    def leave(self, fill: int) -> tuple[int, int]:
        """(fill, rows opened) on leaving."""
        opened = self.openings(fill)
        if opened:
            return self.fill_from(opened[-1]), len(opened)
        return (self.fill_from(0) if fill == 0 else fill + int(self.upto[-1])), 0

    def steps(self) -> Steps:
        """The map of all fills from 0 to `room`."""
        fills = np.arange(1, self.room + 1)
        first = self.first_misfit(fills)
        starts = np.unique(first[first < self.count])
        known: dict[int, tuple[int, int]] = {}
        for at in starts[::-1].tolist():
            path, j = [], at
            while j < self.count and j not in known:
                path.append(j)
                j = int(self.stop[j])
            fill, rows = known[j] if j < self.count else (self.fill_from(path[-1]), 0)
            for i in reversed(path):
                rows += 1
                known[i] = (fill, rows)
        fill, rows = np.empty(self.room + 1, np.int64), np.zeros(self.room + 1, np.int64)
        fill[0], rows[0] = self.leave(0)
        through = np.append(False, first == self.count)
        fill[through] = np.flatnonzero(through) + self.upto[-1]
        for at in starts.tolist():
            mine = np.append(False, first == at)
            fill[mine], rows[mine] = known[at]
        return Steps.of(fill, rows)

    def places(self, fill: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(row number, start) of each document, given fill and row number on entry."""
        opened = np.array(self.openings(fill), np.int64)
        at = np.arange(self.count)
        rank = np.searchsorted(opened, at, side="right")
        opener = np.append(0, opened)[rank]
        z = np.minimum(self.filled[opener], self.count)
        start = np.where(at <= z, 0, self.upto[at] - self.upto[z])
        if fill:
            start = np.where(rank == 0, fill + 1 + self.upto[at], start)
        return row + rank, start


@dataclass
class Steps:
    """A map of fills as steps: from `begin[k]` on fills become `fill[k]`, or are raised by it where `adds[k]`, and `rows[k]` rows open."""

    begin: np.ndarray
    fill: np.ndarray
    rows: np.ndarray
    adds: np.ndarray

    @classmethod
    def of(cls, fill: np.ndarray, rows: np.ndarray) -> Steps:
        own = np.arange(len(fill))
        adds = np.append(fill[1:] == fill[:-1] + 1, False) | np.append(False, fill[1:] == fill[:-1] + 1)
        value = np.where(adds, fill - own, fill)
        new = np.append(True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]) | (adds[1:] != adds[:-1]))
        at = np.flatnonzero(new)
        return cls(at, value[at], rows[at], adds[at])

    def __call__(self, fill: np.ndarray | int) -> tuple[Any, Any]:
        k = np.searchsorted(self.begin, fill, side="right") - 1
        return np.where(self.adds[k], fill + self.fill[k], self.fill[k]), self.rows[k]

    def then(self, other: Steps, room: int) -> Steps:
        fill, rows = self(np.arange(room + 1))
        last, more = other(fill)
        return Steps.of(last, rows + more)


@dataclass
class Summary:
    """What documents do to the state (batch, fill, row): `head` is the map of the batch that they begin with; if others follow, `tail` is the state on leaving."""

    first: Any
    head: Steps
    last: Any
    tail: tuple[int, int] | None

    def leave(self, batch: Any, fill: int, row: int) -> tuple[Any, int, int]:
        if self.tail is not None:
            return self.last, *self.tail
        if batch != self.first:
            fill, row = 0, 0
        fill, rows = self.head(fill)
        return self.last, int(fill), row + int(rows)

    def then(self, other: Summary, room: int) -> Summary:
        if self.tail is not None:
            _, fill, row = other.leave(self.last, *self.tail)
            return Summary(self.first, self.head, other.last, (fill, row))
        if other.first == self.first:
            return Summary(self.first, self.head.then(other.head, room), other.last, other.tail)
        _, fill, row = other.leave(None, 0, 0) if other.first is not None else other.leave(_OTHER, 0, 0)
        return Summary(self.first, self.head, other.last, (fill, row))


_OTHER = object()


def runs_of(batch: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of stretches of one batch; a null batch is one like any other."""
    code = batch.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return list(zip(at.tolist(), np.append(at[1:], len(code)).tolist(), strict=True))


def summary_of(batch: pa.Array, n: np.ndarray, room: int) -> Summary:
    runs = runs_of(batch)
    (a, b), (c, d) = runs[0], runs[-1]
    tail = None if len(runs) == 1 else Run(n[c:d], room).leave(0)
    return Summary(batch[a].as_py(), Run(n[a:b], room).steps(), batch[c].as_py(), tail)


_STEPS = "begin array<long>, fill array<long>, rows array<long>, adds array<boolean>, tail_fill long, tail_row long"


def _written(blocks: list[int], found: list[Summary], kind: pa.DataType) -> pa.Table:
    lists = lambda name, t: pa.array([getattr(s.head, name).tolist() for s in found], pa.list_(t))
    tails = [s.tail or (None, None) for s in found]
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "first": pa.array([s.first for s in found], kind), "last": pa.array([s.last for s in found], kind),
        **{c: lists(c, pa.int64()) for c in ("begin", "fill", "rows")}, "adds": lists("adds", pa.bool_()),
        "tail_fill": pa.array([t[0] for t in tails], pa.int64()), "tail_row": pa.array([t[1] for t in tails], pa.int64()),
    })


def _read(table: pa.Table) -> Iterator[tuple[int, Summary]]:
    for r in table.sort_by("block").to_pylist():
        head = Steps(np.array(r["begin"]), np.array(r["fill"]), np.array(r["rows"]), np.array(r["adds"], bool))
        yield r["block"], Summary(r["first"], head, r["last"], None if r["tail_fill"] is None else (r["tail_fill"], r["tail_row"]))


def _summaries(room: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal").combine_chunks()
        batch = table.column("batch").combine_chunks()
        return _written([key[0].as_py()], [summary_of(batch, table.column("n").to_numpy().astype(np.int64), room)], batch.type)

    return run


def _composed(room: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = None
        for _, s in _read(table):
            out = s if out is None else out.then(s, room)
        return _written([key[0].as_py()], [out], table.column("first").type)

    return run


def _entries(table: pa.Table, state: tuple[Any, int, int]) -> pa.Table:
    """State on entry of each block of `table`, given that of the first."""
    rows = []
    for block, s in _read(table):
        rows.append((block, *state))
        state = s.leave(*state)
    blocks, batch, fill, row = zip(*rows, strict=True)
    kind = table.column("first").type
    return pa.table({"block": pa.array(blocks, pa.int64()), "in_batch": pa.array(batch, kind), "in_fill": pa.array(fill, pa.int64()), "in_row": pa.array(row, pa.int64())})


def _scanned(key: tuple, table: pa.Table) -> pa.Table:
    if "in_fill" not in table.column_names:
        return _entries(table, (table.sort_by("block").column("first")[0].as_py(), 0, 0))
    state = tuple(table.column(c)[0].as_py() for c in ("in_batch", "in_fill", "in_row"))
    return _entries(table, state)


def _placed(room: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal").combine_chunks()
        batch, n = table.column("batch").combine_chunks(), table.column("n").to_numpy().astype(np.int64)
        known, fill, row = (table.column(c)[0].as_py() for c in ("in_batch", "in_fill", "in_row"))
        number, start = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for k, (a, b) in enumerate(runs_of(batch)):
            state = (fill, row) if k == 0 and batch[a].as_py() == known else (0, 0)
            number[a:b], start[a:b] = Run(n[a:b], room).places(*state)
        return pa.table({"batch": batch, "place": table.column("place"), "row_no": pa.array(number), "start": pa.array(start), "end": pa.array(start + n)})

    return run


def pack(df: DataFrame, batch: str, order: str, length: str, room: int, block: int | None = None, fan: int | None = None) -> DataFrame:
    """batch, order, row_no, start, end: where next-fit packing puts each document of a batch.

    Documents of a batch stand in order of `order`, then of length; a longer one than a row is cut to one; a null length is
    0.  An empty one at the start of a row takes no separator.  A null batch is one like any other.
    """
    if room <= 0:
        raise ValueError("the row length is positive")
    block, fan = block or BLOCK, fan or FAN
    kinds = df.select(batch, order).schema
    docs = df.select(F.col(batch).alias("batch"), F.col(order).alias("place"), F.coalesce(F.least(F.greatest(F.col(length).cast("long"), F.lit(0)), F.lit(room)), F.lit(0)).cast("int").alias("n"))
    docs = readers.with_ordinal(docs, "batch", "place", "n").withColumn("block", F.floor(F.col("ordinal") / block).cast("long"))
    field = lambda name, of: T.StructField(name, of)
    key = kinds[batch].dataType
    summary = T.StructType([field("block", T.LongType()), field("first", key), field("last", key), *T._parse_datatype_string(_STEPS).fields])
    entry = T.StructType([field("block", T.LongType()), field("in_batch", key), *T._parse_datatype_string("in_fill long, in_row long").fields])
    levels = [shared.written(docs.select("block", "ordinal", "batch", "n").groupBy("block").applyInArrow(_summaries(room), summary), "blocks")]
    parent = F.floor(F.col("block") / fan).cast("long")
    while levels[-1].count() > fan:
        up = levels[-1].select(parent.alias("up"), "*").groupBy("up").applyInArrow(lambda k, t: _composed(room)(k, t.drop_columns("up")), summary)
        levels.append(shared.written(up, "blocks"))
    states = levels[-1].groupBy(F.lit("all")).applyInArrow(_scanned, entry)
    for level in reversed(levels[:-1]):
        states = level.withColumn("up", parent).join(states.withColumnRenamed("block", "up"), "up").groupBy("up").applyInArrow(_scanned, entry)
    result = T.StructType([field("batch", key), field("place", kinds[order].dataType), *T._parse_datatype_string("row_no long, start long, end long").fields])
    placed = docs.join(states, "block").groupBy("block").applyInArrow(_placed(room), result)
    return placed.select(F.col("batch").alias(batch), F.col("place").alias(order), "row_no", "start", "end")
