"""Byte-level BPE over whole Arrow batches.

Gives exactly the ids of the `tokenizers` library for a byte-level BPE file
(the tests hold them against it) at several times its speed: the pre-tokeniser
works on code points of a whole slice with numpy, each distinct piece of a
slice is encoded once, and its ids are gathered for every occurrence.  Known
pieces stay in a bounded cache of the worker.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import regex
import tiktoken

from quern.llm import wordscan as ws

SLICE = 1_000_000
CACHE = 1_500_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: the pre-tokeniser's fixed pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _classes() -> np.ndarray:
    every = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        found = regex.findall(pattern, "".join(every))
        table[[ord(x) for x in found]] = kind
    return table


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level BPE files write bytes: printable Latin-1 stands for itself, the rest from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Encoded:
    """ids of a slice; text d has ids `first[d]:first[d + 1]`. chars: the slice's code point offset of each text and of each id's piece."""

    ids: np.ndarray
    first: np.ndarray
    length: np.ndarray  # bytes of each id
    char_first: np.ndarray


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        for piece, i in self.special.items():
            self.bytes_of[i] = piece.encode()
        self.byte_len = np.array([len(x) for x in self.bytes_of], np.int64)
        #: ids after which a sentence may end
        self.stops = np.array([x[-1:] in (b".", b"!", b"?", b"\n") for x in self.bytes_of])
        self.line_break = ranks[b"\n"]
        self.class_of = _classes()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _pieces(self, points: np.ndarray, border: np.ndarray, special: list[tuple[int, int]]) -> np.ndarray:
        """Starts of pieces. border: flags of positions where a text (or a special token) starts or has just ended."""
        n = len(points)
        kind = self.class_of[points]
        run = border[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        after = np.flatnonzero(run[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~border[1:n]) + 1
        start[after - 1] = True  # the last white space of a run that ends before a word stands alone ...
        start[after[points[after - 1] == 0x20]] = False  # ... or is a blank that joins the word
        quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & run[1:] & (kind[1:] == _LETTER) & ~border[1:n]) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
            third = np.minimum(quote + 2, n - 1)
            pair = points[quote + 1].astype(np.int64) * 0x110000 + points[third]
            two = np.isin(pair, [ord(x[0]) * 0x110000 + ord(x[1]) for x in ("re", "ve", "ll")]) & (quote + 2 < n) & ~border[third]
            start[quote[one | two] + 1] = False
            for end in (quote[one] + 2, quote[two] + 3):
                start[end[end < n]] = True
        for a, b in special:
            start[a + 1 : b] = False
        return np.flatnonzero(start)

    def _encode_pieces(self, text: str, starts: np.ndarray, ends: np.ndarray, special: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids). Pieces go to the library in one call, a line break between them: none but
        white space and special tokens, which go alone, can join with it."""
        pieces = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        alone = {i: [self.special[x]] if int(starts[i]) in special else self.bpe.encode_ordinary(x) for i, x in enumerate(pieces) if x.isspace() or int(starts[i]) in special}
        ids = np.array(self.bpe.encode_ordinary("\n".join([x for i, x in enumerate(pieces) if i not in alone])), np.uint32)
        breaks = np.flatnonzero(ids == self.line_break)
        sizes = np.zeros(len(pieces), np.int64)
        joined = np.array([i for i in range(len(pieces)) if i not in alone], np.int64)
        if len(joined):
            sizes[joined] = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
            ids = np.delete(ids, breaks)
        for i, x in alone.items():
            sizes[i] = len(x)
        flat = np.zeros(int(sizes.sum()), np.uint32)
        owner = np.repeat(np.isin(np.arange(len(pieces)), joined), sizes)
        flat[owner] = ids
        flat[~owner] = [y for _, x in sorted(alone.items()) for y in x]
        return sizes, flat

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> Encoded:
        """ids of the texts `data[offsets[d]:offsets[d + 1]]` (UTF-8)."""
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        char_first = before[offsets]
        n = len(points)
        border = np.zeros(n + 1, bool)
        border[char_first] = True
        special = [m.span() for x in self.special for m in regex.finditer(regex.escape(x), text)]
        special = [(a, b) for a, b in special if not border[a + 1 : b].any()]
        for a, b in special:
            border[[a, b]] = True
        if not n:
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), char_first)
        starts = self._pieces(points, border, special)
        total = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * ws._power("base", ws._BASE, n), dtype=np.uint64))
        ends = np.append(starts[1:], n)
        hashed = ws.mix((total[ends] - total[starts]) * ws._power("inv", ws._INV, n)[starts])
        if special:  # the same string may also stand where it is not a special token
            hashed[np.searchsorted(starts, [a for a, _ in special])] ^= np.uint64(0x5851F42D4C957F2D)
        which, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        spot = np.searchsorted(self.known, which)
        spot[spot == len(self.known)] = 0
        new = np.flatnonzero(self.known[spot] != which) if len(self.known) else np.arange(len(which))
        if len(new):
            sizes, flat = self._encode_pieces(text, starts[first[new]], ends[first[new]], {a for a, _ in special})
            self.flat = np.append(self.flat, flat)
            slots = np.arange(len(new)) + len(self.at) - 1
            self.at = np.append(self.at, self.at[-1] + np.cumsum(sizes))
            spot = np.searchsorted(self.known, which[new])
            self.slot = np.insert(self.slot, spot, slots)
            self.known = np.insert(self.known, spot, which[new])
        slot = self.slot[np.searchsorted(self.known, which)][inverse]
        sizes = self.at[slot + 1] - self.at[slot]
        done = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.at[slot] - done[:-1], sizes) + np.arange(done[-1])]
        return Encoded(ids, done[np.searchsorted(starts, char_first)], self.byte_len[ids], char_first)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
