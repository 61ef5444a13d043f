"""Attention masks of packed rows as intervals: a document is one interval, whatever its length.

A row's mask is block-diagonal and causal: a position sees the earlier ones of its own document and itself; separators and
padding see themselves.  So the mask of a row is its width and the intervals of its documents, some numbers instead of a
square of them.  What follows works on that form: counts, single positions, slices, rows put behind each other, and the
expansion to one interval of visible keys a position, which is exact and grows with the row and not with its square.

    struct<width: int, docs: array<struct<start: int, stop: int>>>    stop exclusive, documents in order
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.answers import let

_DOCS = "array<struct<start: int, stop: int>>"


def _mask(width: Column, docs: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), docs.cast(_DOCS).alias("docs"))


def of_boundaries(boundaries: Column, width: Column, start: str = "start", stop: str = "end") -> Column:
    """The mask of a row whose documents' bounds are known; empty documents see nothing."""
    pairs = F.transform(boundaries, lambda b: F.struct(b[start].cast("int").alias("start"), b[stop].cast("int").alias("stop")))
    return _mask(width, F.array_sort(F.filter(pairs, lambda b: b["start"] < b["stop"])))


def of_doc_ids(doc_ids: Column) -> Column:
    """The mask of a row of document numbers, negative where there is none; a document's positions stand together."""
    starts = F.filter(F.transform(doc_ids, lambda d, i: F.when((d >= 0) & ((i == 0) | (F.get(doc_ids, F.greatest(i - 1, F.lit(0))) != d)), i).otherwise(-1)), lambda i: i >= 0)
    stops = F.filter(F.transform(doc_ids, lambda d, i: F.when((d >= 0) & F.coalesce(F.get(doc_ids, i + 1) != d, F.lit(True)), i + 1).otherwise(-1)), lambda i: i >= 0)
    return _mask(F.size(doc_ids), F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def visible(mask: Column) -> Column:
    """How many pairs of positions the mask allows."""
    n = lambda d: (d["stop"] - d["start"]).cast("long")
    return let(mask, lambda m: _total(F.transform(m["docs"], lambda d: F.floor(n(d) * (n(d) + 1) / 2).cast("long"))) + m["width"] - _total(F.transform(m["docs"], n)))


def allows(mask: Column, query: Column, key: Column) -> Column:
    """Whether a position may look at another; false outside the row."""
    inside = (query >= 0) & (query < mask["width"]) & (key >= 0) & (key < mask["width"])
    one = F.exists(mask["docs"], lambda d: (d["start"] <= key) & (key <= query) & (query < d["stop"]))
    return inside & (one | (query == key))


def sliced(mask: Column, begin: Column, end: Column) -> Column:
    """The mask of the positions from `begin` up to `end` alone, numbered from 0; positions that the row doesn't have are left out."""
    lo = F.greatest(begin, F.lit(0))

    def cut(m: Column) -> Column:
        hi = F.greatest(F.least(end, m["width"]), lo)
        parts = F.transform(m["docs"], lambda d: F.struct((F.greatest(d["start"], lo) - lo).alias("start"), (F.least(d["stop"], hi) - lo).alias("stop")))
        return _mask(hi - lo, F.filter(parts, lambda d: d["start"] < d["stop"]))

    return let(mask, cut)


def behind(masks: Column) -> Column:
    """One mask of an array of masks: rows put behind each other, still apart."""
    empty = _mask(F.lit(0), F.array())
    moved = lambda m, by: F.transform(m["docs"], lambda d: F.struct((d["start"] + by).alias("start"), (d["stop"] + by).alias("stop")))
    return F.aggregate(masks, empty, lambda acc, m: _mask(acc["width"] + m["width"], F.concat(acc["docs"], moved(m, acc["width"]))))


def union(a: Column, b: Column) -> Column:
    """The mask of a row that has the documents of both; documents of the two may not overlap, and the wider row counts."""
    def one(x: Column, y: Column) -> Column:
        docs = F.array_sort(F.array_distinct(F.concat(x["docs"], y["docs"])))
        # of documents in order, each starts where the one before has stopped, or later
        clash = F.exists(F.sequence(F.lit(1), F.size(docs)), lambda i: F.coalesce(F.get(docs, i)["start"] < F.get(docs, i - 1)["stop"], F.lit(False)))
        fault = F.raise_error(F.lit("documents of the two masks overlap")).cast(_DOCS)
        return _mask(F.greatest(x["width"], y["width"]), F.when(clash, fault).otherwise(docs))

    return let(a, lambda x: let(b, lambda y: one(x, y)))


def positions(df: DataFrame, mask: str, *keep: str) -> DataFrame:
    """keep, query, first_key: a row a position; it sees the keys from first_key to itself."""
    m = F.col(mask)
    inside = F.flatten(F.transform(m["docs"], lambda d: F.transform(F.sequence(d["start"], d["stop"] - 1), lambda i: F.struct(i.alias("query"), d["start"].alias("first_key")))))
    # positions between documents, before the first and behind the last see themselves
    edges = F.concat(F.array(F.lit(0)), m["docs"]["stop"])
    until = F.concat(m["docs"]["start"], F.array(m["width"]))
    gaps = F.filter(F.zip_with(edges, until, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] < g["b"])
    alone = F.flatten(F.transform(gaps, lambda g: F.transform(F.sequence(g["a"], g["b"] - 1), lambda i: F.struct(i.alias("query"), i.alias("first_key")))))
    return df.select(*keep, F.explode(F.concat(inside, alone)).alias("p")).select(*keep, "p.query", "p.first_key")


def dense(mask: Column) -> Column:
    """The square of zeros and ones, for small rows and tests."""
    return let(mask, lambda m: F.when(m["width"] > 0, F.transform(F.sequence(F.lit(0), m["width"] - 1), lambda i: F.transform(F.sequence(F.lit(0), m["width"] - 1), lambda j: allows(m, i, j).cast("int")))).otherwise(F.array().cast("array<array<int>>")))
