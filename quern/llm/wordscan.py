"""Vectorised word scanning over Arrow string columns.

The operators that look at every word of every text (shingles, winnowing,
language scores) share this module.  It works on the UTF-8 bytes of a whole
batch at once: a 256-entry table marks word bytes, word borders come from one
``diff``, and a word's 64-bit hash comes from prefix sums of a polynomial, so
no Python object is made per word.

Batches are cut into slices of at most :data:`SLICE_BYTES` bytes of text (a
longer text is a slice of its own), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def byte_table(separators: bytes | range | list[int], lower: bool = True) -> np.ndarray:
    """Table byte -> value to hash: 0 for separators, else the (lower-cased) byte plus 1."""
    table = np.arange(256, dtype=np.uint16) + 1
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


#: words `[^\x20\x09-\x0D]+`
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased
ALNUM = byte_table([x for x in range(128) if not chr(x).isalnum()])


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a slice: ``hash[i]`` and its bytes ``start[i]:end[i]``; text d has words ``first[d]:first[d + 1]``."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, offsets, bytes) of runs of rows whose texts have at most `limit` bytes together."""
    at, data = text_buffers(column)
    lo = 0
    while lo < len(at) - 1:
        hi = int(np.searchsorted(at, at[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(at) - 1)
        yield lo, hi, at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]]
        lo = hi


def scan(offsets: np.ndarray, data: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts `data[offsets[d]:offsets[d + 1]]` under a byte table."""
    value = table[data]
    word = value != 0
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = len(data) > 0 and word[0], False
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[word[inner] & word[inner - 1]]  # a word on both sides of a text border
    starts = np.flatnonzero(edge[:-1] & word)
    ends = np.flatnonzero(np.append(~word[1:] & word[:-1], word[-1:])) + 1 if len(data) else np.zeros(0, np.int64)
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(value * _power("base", _BASE, len(data)), dtype=np.uint64, out=total[1:])
    hashed = mix((total[ends] - total[starts]) * _power("inv", _INV, len(data) + 1)[starts])
    return Words(hashed, np.searchsorted(starts, offsets), starts, ends)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i + k] for every i that has k words after it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += words[j : n + j]
    return mix(out)
