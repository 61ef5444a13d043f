r"""Step alignment of reasoning chains: which steps of a reference chain a response makes, in order, and what it leaves out or adds.

A chain is a text of steps, one a line.  Two steps match when they come to the
same number, or, where a step has none, when they have the same words; of matching
steps those with the same words are `exact`, the others reworded.  An alignment
keeps the order of both chains.  The best one has the most matches, then the
fewest reworded ones; of equally good ones the one that, read from the start,
matches rather than skips and skips in the reference rather than in the response.

That is a dynamic programme over suffixes of both lists.  It looks at a band of
diagonals only: every alignment that leaves a band of half width k skips at least
2 (k + 1) steps more than the lengths demand, so a cheaper result within the band
is proven; otherwise the band is doubled.  Time is linear in the length of chains
for a given number of differences.  Chains of similar length are worked off
together, a row of the band at a time; rows of moves are made again from kept
rows, :data:`MOVES` bytes of them at a time, so memory does not follow the
product of the lengths.

Nothing is shuffled: a pair of chains is one row.  A null text has no steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import answers

#: numbers and bullets before a step
_MARK = r"(?i)^\s*(?:(?:step\s*)?\d+\s*[:.)]|[-*•])\s+"
BAND = 4
#: bytes of moves, and cells of padded chains, that are held together
MOVES, CELLS = 1 << 24, 1 << 20
_FAR = 1 << 50
_MATCH, _MISSING, _EXTRA = 0, 1, 2


def steps(text: Column) -> Column:
    """The steps of a text: its lines without marks and outer white space, blank ones left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: answers.strip(F.regexp_replace(x, _MARK, "")))
    return F.filter(lines, lambda x: x != "")


def step_words(step: Column) -> Column:
    """Letters, digits, points and signs of a step in lower case, one blank between."""
    return F.trim(F.regexp_replace(F.lower(step), r"[^\p{L}\p{N}.%$-]+", " "))


def _spelled(number: Column) -> Column:
    """One spelling of each number of the form that `answers.last_number` gives: no outer zeros, no point at the end, no sign of zero."""
    digits = F.ltrim(F.replace(number, F.lit("-"), F.lit("")), F.lit("0"))
    short = answers.let(digits, lambda x: F.when(x.contains("."), F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))).otherwise(x))
    return answers.let(short, lambda x: F.when(x == "", "0").when(number.startswith("-"), F.concat(F.lit("-"), x)).otherwise(x))


def step_key(step: Column) -> Column:
    """What a step comes to: its last number in one spelling, else its words."""
    # the general spelling of `scoring` allows for signs, exponents and digits that such a number can't have, at several times the cost
    number = answers.let(answers.last_number(step), lambda x: F.when(x.isNotNull(), F.concat(F.lit("="), _spelled(x))))
    return F.coalesce(number, step_words(step))


class _Pairs:
    """Chains of a chunk, padded: ids of keys and words (equal ids, equal texts), and their lengths."""

    def __init__(self, gold: list[tuple[np.ndarray, np.ndarray]], response: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(k) for k, _ in gold])
        self.m = np.array([len(k) for k, _ in response])
        self.a, self.aw = self._padded(gold, -1)
        self.b, self.bw = self._padded(response, -2)

    @staticmethod
    def _padded(chains: list[tuple[np.ndarray, np.ndarray]], fill: int) -> tuple[np.ndarray, np.ndarray]:
        out = [np.full((len(chains), max(1, max(len(k) for k, _ in chains))), fill, np.int64) for _ in range(2)]
        for row, chain in enumerate(chains):
            for table, ids in zip(out, chain, strict=True):
                table[row, : len(ids)] = ids
        return out[0], out[1]

    def take(self, rows: np.ndarray) -> _Pairs:
        some = object.__new__(_Pairs)
        for name in ("n", "m", "a", "aw", "b", "bw"):
            setattr(some, name, getattr(self, name)[rows])
        return some


class _Band:
    """The programme over diagonals `low` to `low + width - 1` of each pair; cell t of row i stands for response step i + low + t."""

    def __init__(self, pairs: _Pairs, half: int):
        self.pairs = pairs
        gap = pairs.m - pairs.n
        self.low = np.minimum(gap, 0) - half
        self.width = int((np.maximum(gap, 0) + half - self.low).max()) + 1
        self.skip = int(np.minimum(pairs.n, pairs.m).max()) + 1
        self.limit = self.skip * (np.abs(gap) + 2 * (half + 1))
        self.t = np.arange(self.width)
        self.rows = int(pairs.n.max()) + 1

    def above(self, i: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least costs from row i on, and the move that each cell makes, given row i + 1."""
        p = self.pairs
        j = i + self.low[:, None] + self.t
        inside = (j >= 0) & (j <= p.m[:, None])
        at = np.clip(j, 0, p.b.shape[1] - 1)
        if i < p.a.shape[1]:
            same = (p.a[:, i, None] == np.take_along_axis(p.b, at, axis=1)) & (j < p.m[:, None]) & (j >= 0)
            reworded = p.aw[:, i, None] != np.take_along_axis(p.bw, at, axis=1)
            match = np.where(same, below + reworded, _FAR)
        else:
            match = np.full_like(below, _FAR)
        missing = np.full_like(below, _FAR)
        missing[:, 1:] = below[:, :-1] + self.skip
        best = np.minimum(match, missing)
        last = p.n == i
        best[last] = np.where(j[last] == p.m[last, None], 0, _FAR)
        best = np.where(inside, best, _FAR)
        # a skip in the response goes one cell to the right in the same row
        along = self.t * self.skip
        best = np.minimum.accumulate((best + along)[:, ::-1], axis=1)[:, ::-1] - along
        best = np.where(inside & (p.n >= i)[:, None], np.minimum(best, _FAR), _FAR)
        move = np.where(match == best, _MATCH, np.where(missing == best, _MISSING, _EXTRA)).astype(np.int8)
        return best, move

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are proven, and the matches of these as (pair, step of the reference, step of the response), in order."""
        count = len(self.pairs.n)
        stretch = max(1, min(self.rows, MOVES // (count * self.width)))
        kept = {self.rows: np.full((count, self.width), _FAR, np.int64)}
        if stretch < self.rows:
            row = kept[self.rows]
            for i in range(self.rows - 1, stretch - 1, -1):
                row, _ = self.above(i, row)
                if i % stretch == 0:
                    kept[i] = row
        i, j = np.zeros(count, np.int64), np.zeros(count, np.int64)
        found: list[np.ndarray] = []
        for begin in range(0, self.rows, stretch):
            end = min(begin + stretch, self.rows)
            row, moves = kept.pop(end), np.empty((end - begin, count, self.width), np.int8)
            for k in range(end - 1, begin - 1, -1):
                row, moves[k - begin] = self.above(k, row)
            if not begin:
                proven = row[np.arange(count), -self.low] < self.limit
                proven |= (self.low <= -self.pairs.n) & (self.low + self.width > self.pairs.m)
            while len(live := np.flatnonzero(proven & (i < np.minimum(self.pairs.n, end)))):
                move = moves[i[live] - begin, live, j[live] - i[live] - self.low[live]]
                hit = live[move == _MATCH]
                found.append(np.stack([hit, i[hit], j[hit]], axis=1))
                i[live[move != _EXTRA]] += 1
                j[live[move != _MISSING]] += 1
        matches = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return proven, matches[np.lexsort((matches[:, 1], matches[:, 0]))]


def align_lists(gold: list[tuple[np.ndarray, np.ndarray]], response: list[tuple[np.ndarray, np.ndarray]], band: int = BAND) -> list[np.ndarray]:
    """Matched places (reference, response) of each pair of chains; a chain is its ids of keys and of words."""
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(gold)
    size = np.array([len(a[0]) + len(b[0]) for a, b in zip(gold, response, strict=True)])
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= CELLS:
            hi += 1
        rows = order[lo:hi]
        lo = hi
        pairs, half = _Pairs([gold[r] for r in rows], [response[r] for r in rows]), band
        while len(rows):
            proven, matches = _Band(pairs, half).solve()
            cuts = np.searchsorted(matches[:, 0], np.arange(len(rows) + 1))
            for k in np.flatnonzero(proven).tolist():
                out[rows[k]] = matches[cuts[k] : cuts[k + 1], 1:]
            rows, pairs, half = rows[~proven], pairs.take(~proven), 2 * half
    return out


RESULTS = ("n_gold", "n_response", "matched", "reworded", "missing", "extra", "gold_places", "response_places", "first_missing")
_RESULT = "n_gold int, n_response int, matched int, reworded int, gold_places array<int>, response_places array<int>"


def _chains(column: pa.Array, keys: np.ndarray, words: np.ndarray, begin: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """A (keys, words) pair of id arrays for each list of `column`, ids taken from `begin` on."""
    at = begin + np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
    return [(keys[a:b], words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], int(at[-1])


def _aligned(band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gold, response = batch.column("gold"), batch.column("response")
            flat = pa.concat_arrays([gold.flatten(), response.flatten()])
            keys, words = (flat.field(k).dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in (0, 1))
            a, end = _chains(gold, keys, words, 0)
            b, _ = _chains(response, keys, words, end)
            places = align_lists(a, b, band)
            reworded = [int((x[1][p[:, 0]] != y[1][p[:, 1]]).sum()) for x, y, p in zip(a, b, places, strict=True)]
            ints = lambda values: pa.array(values, pa.int32())
            offsets = ints(np.append(0, np.cumsum([len(p) for p in places])))
            every = np.concatenate(places) if places else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("all"), ints([len(k) for k, _ in a]), ints([len(k) for k, _ in b]), ints([len(p) for p in places]), ints(reworded),
                    *[pa.ListArray.from_arrays(offsets, ints(every[:, side])) for side in (0, 1)],
                ],
                names=["all", "n_gold", "n_response", "matched", "reworded", "gold_places", "response_places"],
            )

    return run


def align(df: DataFrame, gold: str = "gold_chain", response: str = "response_chain", band: int = BAND, keep: Sequence[str] | None = None) -> DataFrame:
    """`df` with n_gold, n_response, matched, reworded, missing, extra, gold_places, response_places and first_missing.

    The two lists of places, from 0, say which steps match; first_missing is the first step of the reference without a
    match, null if there is none. Columns of `df` that have a result's name are left out, and those not in `keep` if that is
    given, so that texts nobody asks for don't pass through Python.
    """
    if band < 0:
        raise ValueError("a band has no negative width")
    keyed = lambda text: F.transform(steps(F.col(text)), lambda x: F.struct(step_key(x).alias("key"), step_words(x).alias("words")))
    keep = [c for c in df.columns if c not in RESULTS and (keep is None or c in keep)]
    made = df.select(F.struct(*keep).alias("all"), keyed(gold).alias("gold"), keyed(response).alias("response"))
    schema = T.StructType([made.schema["all"], *T._parse_datatype_string(_RESULT).fields])
    out = made.mapInArrow(_aligned(band), schema)
    lost = F.array_min(F.array_except(F.when(F.col("n_gold") > 0, F.sequence(F.lit(0), F.col("n_gold") - 1)).otherwise(F.array().cast("array<int>")), F.col("gold_places")))
    counts = ["n_gold", "n_response", "matched", "reworded"]
    return out.select(*[F.col("all")[c].alias(c) for c in keep], *counts, (F.col("n_gold") - F.col("matched")).alias("missing"), (F.col("n_response") - F.col("matched")).alias("extra"), "gold_places", "response_places", lost.alias("first_missing"))


def chain_report(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, chains, complete (all steps, none added), step_recall, step_precision (0.0 without steps), reworded, missing, extra."""
    total = lambda c: F.coalesce(F.sum(c).cast("long"), F.lit(0).cast("long"))
    ratio = lambda a, b: F.when(total(b) > 0, total(a) / total(b)).otherwise(0.0)
    whole = (F.col("missing") == 0) & (F.col("extra") == 0)
    return aligned.groupBy(*keys).agg(
        F.count("*").alias("chains"), F.count_if(whole).alias("complete"), ratio("matched", "n_gold").alias("step_recall"), ratio("matched", "n_response").alias("step_precision"),
        *[total(c).alias(c) for c in ("reworded", "missing", "extra")],
    )
