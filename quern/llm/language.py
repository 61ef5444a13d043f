"""Language identification (operator 10) by segmentation-marginalised unigrams.

The pieces of a fixed public byte-level vocabulary have a probability in each
language.  A word's probability is the sum over all its segmentations into
pieces, found by the forward algorithm over its bytes; a text's is the product
over its words.  The posterior under equal priors gives the language and the
score.  A word is a run of ASCII letters and non-ASCII characters, of any
length, with a blank before it, ASCII letters lower-cased.  All pieces of the
vocabulary take part.

The forward algorithm adds logarithms and looks back as far as the longest piece
that can stand in a word, so words of any length neither underflow nor are cut:
its state is a window of that many positions.  Words of similar length are worked
off together; one of more than :data:`STRETCH` bytes in stretches that hand the
window on.

Piece probabilities come from expectation-maximisation on the word counts of
at most :data:`SAMPLE` documents per language with :data:`SAMPLE_BYTES` bytes
together, those with the least hash of their id; rows that repeat id and text
count once, and words of more than :data:`FIT_WORD_BYTES` bytes don't.  These
bounds are for fitting only; every text and word is scored whole.  A language's
counts are smoothed with those of all languages together.

Scoring works on slices of a batch: each distinct word is scored once (a
bounded cache keeps scores), texts sum the scores of their words.

Defined results: `und` with score 0 for null texts and texts without a letter,
and for all texts if there is nothing to learn from.  Of equal languages the
first by name is taken.  Documents whose id or language is null, or that are
held out, are never learned from; a null id is not held out.  Repeated rows
each get a row.  Only text, and for learning doc_id and lang, are looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm import wordscan as ws

#: per language, documents and bytes of text that are learned from; a text of more than TEXT_BYTES is not
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 200, 8_000_000, 1_000_000
ROUNDS = 4
FIT_WORD_BYTES = 4096
#: bytes of padded words that are worked off together, and of a stretch of a longer word
CELLS, STRETCH = 1 << 19, 1 << 16
CACHE = 400_000
SLICE = 1_000_000
_WORD = ws.byte_table([b for b in range(128) if not chr(b).isalpha()])
_SHARED, _FLOOR = 200.0, 1e-9


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level BPE file, all single bytes included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = tokens._byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = {bytes(alphabet[c] for c in p) for p in spec["model"]["vocab"] if p not in special}
    return sorted(pieces | {bytes([b]) for b in range(256)})


def _hash_rows(matrix: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial along the rows of a byte matrix; column j covers bytes before j."""
    power = ws._power("base", ws._BASE, matrix.shape[1])
    out = np.zeros((matrix.shape[0], matrix.shape[1] + 1), np.uint64)
    np.cumsum((matrix.astype(np.uint64) + np.uint64(1)) * power, axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


class Pieces:
    """Numbers of the pieces that can stand in a word, found by length and hash. Others keep their number, as they have a probability too."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.size = np.array([len(x) for x in pieces])
        by: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            if all(b >= 128 or 97 <= b <= 122 for b in (x[1:] if x[:1] == b" " else x)):
                by.setdefault(len(x), []).append(i)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, numbers in sorted(by.items()):
            matrix = np.frombuffer(b"".join(pieces[i] for i in numbers), np.uint8).reshape(-1, size)
            keys = ws.mix(_hash_rows(matrix)[:, size])
            order = np.argsort(keys)
            self.of[size] = keys[order], np.array(numbers)[order]
        #: the longest of them
        self.reach = max(self.of)


class Lattice:
    """All pieces in some words: for each end and length, the words that have one there and its number."""

    def __init__(self, pieces: Pieces, matrix: np.ndarray, length: np.ndarray):
        self.length, self.width, self.reach = length, matrix.shape[1], pieces.reach
        total = _hash_rows(matrix)
        back = ws._power("inv", ws._INV, self.width + 1)
        found: list[tuple[np.ndarray, ...]] = []
        for size, (keys, number) in pieces.of.items():
            if size > self.width:
                break
            h = ws.mix((total[:, size:] - total[:, :-size]) * back[: self.width - size + 1])
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            row, begin = np.nonzero((keys[at] == h) & (np.arange(self.width - size + 1) <= (length - size)[:, None]))
            found.append((begin + size, np.full(len(row), size), row, number[at[row, begin]]))
        end, size, row, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, end))
        end, size, row, piece = end[order], size[order], row[order], piece[order]
        cut = np.flatnonzero(np.append(True, (end[1:] != end[:-1]) | (size[1:] != size[:-1]))) if len(end) else np.zeros(0, np.int64)
        #: by end: (length, words, pieces)
        self.steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.width + 1)]
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(end)).tolist(), strict=True):
            self.steps[int(end[a])].append((int(size[a]), row[a:b], piece[a:b]))

    def forward(self, log_p: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """(words, positions, languages): log probability of the bytes before each position.

        known: that of the first positions, where a stretch goes on with what another has left.
        """
        alpha = np.full((len(self.length), self.width + 1, log_p.shape[1]), -np.inf)
        first = 0
        if known is None:
            alpha[:, 0] = 0
        else:
            first = known.shape[1] - 1
            alpha[:, : first + 1] = known
        for end in range(first + 1, self.width + 1):
            for size, row, piece in self.steps[end]:
                alpha[row, end] = np.logaddexp(alpha[row, end], alpha[row, end - size] + log_p[piece])
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        return alpha[np.arange(len(self.length)), self.length]

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations, words counted `counts` (words, languages) times."""
        alpha = self.forward(log_p)
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(self.length)), self.length] = -self.total(alpha)
        pieces, parts = [np.zeros(0, np.int64)], [np.zeros((0, log_p.shape[1]))]
        for end in range(self.width, 0, -1):
            for size, row, piece in self.steps[end]:
                flow = beta[row, end] + log_p[piece]
                beta[row, end - size] = np.logaddexp(beta[row, end - size], flow)
                pieces.append(piece)
                parts.append(np.exp(alpha[row, end - size] + flow) * counts[row])
        every, part = np.concatenate(pieces), np.concatenate(parts)
        return np.stack([np.bincount(every, part[:, k], len(log_p)) for k in range(log_p.shape[1])], axis=1)


def _matrix(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words (a blank before each, ASCII lower-cased), padded, and their lengths."""
    length = ends - starts + 1
    width = int(length.max(initial=1))
    at = starts[:, None] + np.arange(-1, width - 1)[None, :]
    inside = (at >= starts[:, None]) & (at < ends[:, None])
    low = data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    return np.where(inside, low, 32).astype(np.uint8), length


def alike(size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of similar size, at most CELLS bytes when padded, or one row."""
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        # the last row is the longest: as many rows before it as fit, none of less than half its size but short ones
        hi = lo + 1
        least = max(16, 2 * int(size[order[lo]]))
        top = int(np.searchsorted(size[order], least, side="right"))
        width = np.maximum(size[order[lo:top]], 1)
        hi = max(hi, lo + int(np.searchsorted(np.arange(1, len(width) + 1) * width, CELLS, side="right")))
        yield order[lo:hi]
        lo = hi


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # (pieces, languages)
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(texts: list[str], langs: list[str], path: str, rounds: int = ROUNDS) -> Model:
    languages = sorted(set(langs))
    pieces = Pieces(vocabulary(path))
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in langs], np.int64)
    counts: dict[int, np.ndarray] = {}
    lattices: list[tuple[Lattice, np.ndarray]] = []
    slices = []
    for lo, hi, at, data in ws.slices(pa.array(texts, pa.string()), SLICE):
        words = ws.scan(at, data, _WORD)
        which, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        made = np.zeros((len(which), len(languages)))
        np.add.at(made, (inverse, lang[lo:hi][words.owner()]), 1)
        new = [k for k, h in enumerate(which.tolist()) if h not in counts]
        for h, row in zip(which.tolist(), made, strict=True):
            counts[h] = counts[h] + row if h in counts else row
        pick = first[new]
        short = words.end[pick] - words.start[pick] <= FIT_WORD_BYTES
        slices.append((words.start[pick][short], words.end[pick][short], data, which[new][short].tolist()))
    for start, end, data, names in slices:
        for rows in alike(end - start + 1):
            each = np.array([counts[names[r]] for r in rows.tolist()])
            lattices.append((Lattice(pieces, *_matrix(start[rows], end[rows], data)), each))
    # a first guess that prefers long pieces, the same for every language
    guess = 256.0 ** -np.minimum(pieces.size, 4).astype(float) + 1e-3
    p = np.repeat((guess / guess.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        made = sum((lattice.expected(np.log(p), each) for lattice, each in lattices), np.zeros_like(p))
        shared = made.sum(axis=1, keepdims=True)
        shared = (shared + 1e-3) / (shared.sum() + 1e-3 * len(shared))
        p = (made + _SHARED * shared) / (made.sum(axis=0, keepdims=True) + _SHARED)
        p = p * (1 - _FLOOR * len(p)) + _FLOOR
    return Model(languages, pieces, p)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.log_p = np.log(self.model.p)
        self.known = np.zeros(0, np.uint64)
        self.score = np.zeros((0, len(self.model.languages)))

    def words(self, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(start), len(self.model.languages)))
        long = end - start + 1 > STRETCH
        for k in np.flatnonzero(long).tolist():
            out[k] = self.long_word(_matrix(start[k : k + 1], end[k : k + 1], data)[0])
        short = np.flatnonzero(~long)
        for rows in alike((end - start)[short] + 1):
            rows = short[rows]
            lattice = Lattice(self.model.pieces, *_matrix(start[rows], end[rows], data))
            out[rows] = lattice.total(lattice.forward(self.log_p))
        return out

    def long_word(self, matrix: np.ndarray) -> np.ndarray:
        """The same for one word, a stretch at a time; a stretch begins with the bytes that pieces across the border need."""
        known, begin, reach = None, 0, self.model.pieces.reach
        while True:
            end = min(begin + STRETCH, matrix.shape[1])
            part = matrix[:, max(0, begin - reach) : end]
            lattice = Lattice(self.model.pieces, part, np.array([part.shape[1]]))
            alpha = lattice.forward(self.log_p, known)
            if end == matrix.shape[1]:
                return lattice.total(alpha)[0]
            known, begin = alpha[:, -reach - 1 :], end

    def texts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Log probability of each text in each language."""
        words = ws.scan(offsets, data, _WORD)
        if len(self.known) > CACHE:
            self._forget()
        which, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, which)
        if len(self.known):
            at[at == len(self.known)] = 0
            new = np.flatnonzero(self.known[at] != which)
        else:
            new = np.arange(len(which))
        if len(new):
            made = self.words(words.start[first[new]], words.end[first[new]], data)
            at = np.searchsorted(self.known, which[new])
            self.known, self.score = np.insert(self.known, at, which[new]), np.insert(self.score, at, made, axis=0)
        score = self.score[np.searchsorted(self.known, which)][inverse]
        owner = words.owner()
        return np.stack([np.bincount(owner, score[:, k], len(offsets) - 1) for k in range(score.shape[1])], axis=1)


#: the scorer of the model that this worker met last, with its cache
_last: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    if not _last or _last[0].model.mark != model.mark:
        _last[:] = [Scorer(model)]
    return _last[0]


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        scorer = _scorer(known)
        for batch in batches:
            for lo, hi, at, data in ws.slices(batch.column("text"), SLICE):
                log = scorer.texts(at, data)
                letters = np.zeros(256, bool)
                letters[65:91] = letters[97:123] = True
                plain = np.append(0, np.cumsum(letters[data]))[at]
                some = np.diff(plain) > 0
                for d in np.flatnonzero(~some & (np.diff(at) > 0)):  # no ASCII letter: perhaps another
                    some[d] = any(c.isalpha() for c in data[at[d] : at[d + 1]].tobytes().decode("utf-8"))
                best = log.argmax(axis=1)
                score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([known.languages[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)], pa.string()), pa.array(np.where(some, score, 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def training_rows(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list:
    """(lang, text) of the sample, in order; ids, sizes and hashes alone are shuffled, and of those at most `sample` per language and task."""
    can = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    can = can.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size")).where(F.col("size") <= TEXT_BYTES)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
    first = can.select("doc_id", "lang", "mark", "size").withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    once = first.groupBy("lang", "doc_id", "mark").agg(F.min("place").alias("place"), F.first("size").alias("size"))
    upto = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    chosen = once.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= sample_bytes).select("lang", "doc_id", "mark").collect()
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "lang string, doc_id long, mark long"))
    texts = can.join(wanted, ["lang", "doc_id", "mark"], "left_semi").dropDuplicates(["lang", "doc_id", "mark"])
    return sorted((r.lang, r.text) for r in texts.select("lang", "text").collect())


def identify(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = training_rows(docs, sample)
    if not rows:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = fit([t for _, t in rows], [x for x, _ in rows], path or tokens.default_path())
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
