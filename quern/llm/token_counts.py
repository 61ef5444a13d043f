"""Token counts (operator 7): each token of a whole document is attributed to one section.

The fields of a row, a line break between them, are encoded once, together.
Every id has a span of bytes and so of characters; sections are the lines of
each field.  Both are sorted by place, and a merge of the two lists (the
interval join of one document) finds the sections that a token touches.

Allocation rule: a token that crosses a border belongs to the section that has
most of its characters, of equals to the earlier.  A character belongs to the
token that has its first byte; a token without any belongs where the character
lies that it continues.  So each token is counted once, and the sections of a
document sum to its tokens.

Defined results: null fields are empty; an empty field is one section from 0 to
0.  Repeated rows are counted each.  An empty table gives no rows.  Long texts
are encoded whole.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm import wordscan as ws


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Section of each token. borders: where sections start (bytes, first 0); before: characters that start before each byte."""
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, np.maximum(ends - 1, starts), side="right") - 1
    out = first.copy()
    cross = np.flatnonzero(first != last)
    near = cross[last[cross] == first[cross] + 1]
    middle = borders[last[near]]
    out[near] += before[ends[near]] - before[middle] > before[middle] - before[starts[near]]
    for t in cross[last[cross] > first[cross] + 1].tolist():
        edge = np.concatenate([[starts[t]], borders[first[t] + 1 : last[t] + 1], [ends[t]]])
        out[t] = first[t] + int(np.argmax(np.diff(before[edge])))
    return out


_SCHEMA = "doc_id long, field string, section long, start long, end long, n_tokens long, doc_tokens long"


def _counted(path: str, fields: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            sizes_of = np.stack([batch.column(f"size{k}").to_numpy().astype(np.int64) for k in range(len(fields))], axis=1)
            for lo, hi, at, data in ws.slices(batch.column("text"), tokens.SLICE):
                made = encoder.encode(at, data)
                n = np.diff(made.first)
                ends = np.cumsum(made.length)
                starts = ends - made.length
                before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                # fields start at their document's start plus what lies before, line breaks included
                sizes = sizes_of[lo:hi]
                field_at = at[:-1, None] + np.cumsum(sizes + 1, axis=1) - sizes - 1
                lines = np.flatnonzero(data == 10) + 1
                doc_of = np.searchsorted(at, lines - 1, side="right") - 1
                # a line break that ends a field or the last character of one starts no further section
                field_of = (lines[:, None] - 1 >= field_at[doc_of]).sum(axis=1) - 1 if len(lines) else np.zeros(0, np.int64)
                inside = lines < (field_at + sizes)[doc_of, field_of] if len(lines) else np.zeros(0, bool)
                place = np.concatenate([field_at.ravel(), lines[inside]])
                doc = np.concatenate([np.repeat(np.arange(hi - lo), len(fields)), doc_of[inside]])
                field = np.concatenate([np.tile(np.arange(len(fields)), hi - lo), field_of[inside]])
                order = np.lexsort((place, field, doc))
                place, doc, field = place[order], doc[order], field[order]
                # the join wants borders that grow: an empty last section of a slice shares its place with the next document's first
                key, first = np.unique(place[::-1], return_index=True)
                holder = len(place) - 1 - first
                section = holder[allocate(starts, ends, key, before)] if len(starts) else np.zeros(0, np.int64)
                counts = np.bincount(section, minlength=len(place))
                group = doc * len(fields) + field
                begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                number = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
                origin = field_at[doc, field]
                stop = np.append(place[1:], 0)
                final = np.append(group[1:] != group[:-1], True)
                stop[final] = (field_at + sizes)[doc[final], field[final]]
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc)), pa.array(np.array(fields, object)[field], pa.string()), pa.array(number), pa.array(before[place] - before[origin]), pa.array(before[stop] - before[origin]),
                        pa.array(counts.astype(np.int64)), pa.array(n[doc]),
                    ],
                    names=[x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return run


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), path: str | None = None) -> DataFrame:
    """doc_id, field, section (its number in the field), start and end (characters of the field), n_tokens, doc_tokens."""
    own = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    joined = own[0]
    for x in own[1:]:
        joined = F.concat(joined, F.lit("\n"), x)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), joined.alias("text"), *[F.octet_length(x).alias(f"size{k}") for k, x in enumerate(own)])
    return docs.mapInArrow(_counted(path or tokens.default_path(), tuple(fields)), _SCHEMA)
