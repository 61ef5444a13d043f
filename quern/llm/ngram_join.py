"""N-gram Jaccard join (operator 3): all documents whose shingle sets are similar, as components.

Method: a blocked sparse matrix product of the document by shingle incidence.

1. *Sets.*  One pass over whole texts makes each document's sorted set of
   64-bit shingle hashes.  Documents with equal sets form a class, named by 128
   bits of order-free sums; everything later works on classes, so exact copies
   cost one row each.  Half of the name is the key that rows are dealt by;
   where sets that differ share a key, the other half tells them apart.
2. *Size-derived bound.*  Two sets with Jaccard >= 3/4 share at least n/4 of
   the ceil(n/2) least hashes of either.  Those halves are dealt out by hash
   range (the column blocks of the incidence matrix); a block tells which of
   its shingles occur in two or more classes, and how often.  Classes that
   keep fewer than n/4 such shingles cannot link with anything and are done.
   Of the rest, the bound leaves `shared - need + 1` of the rarest shingles:
   linked classes have one of these in common.
3. *Candidates.*  Each such shingle ties its classes to the least of them (a
   star, never all pairs), first within a block of classes, then the least ones
   of the blocks, so that a common shingle sends one row a block; the connected
   components are candidate clusters.
4. *Product.*  A cluster's sets are cut into blocks of bounded weight.  Each
   block is multiplied with itself and with the cluster's hub, the class that
   most stars have in their middle: overlap counts are accumulated over slabs
   of shingles, and pairs with 100 * overlap < 75 * union dropped.  A task
   returns only a spanning forest of the links that it finds, so nothing that
   is emitted grows with the square of a group.  Classes that reach the hub in
   their block are one component already.  Only what is left over is multiplied
   with the other blocks: a group of near copies shuffles its sets once.
5. Components of those links give each document the least doc_id it reaches.

A shingle held by more than a few classes of one map batch (:data:`HOT`, fewer
in larger tables) is hot: it goes last in the order of rarity, and its holders
are sent by class instead of by shingle, so a passage that a third of all
documents carry fills no block.

Defined results: a null text has no words; `n_shingles` is 0 and the document
is its own component.  Repeated rows are kept, one result row each.  Rows that
share a doc_id but not a text are separate documents which carry that id.  A
null doc_id never is a component's name unless nothing else is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import wordscan as ws
from quern.llm.common import BLOCK_BYTES, discard, key_marks, only_marked, partitions, saved
from quern.llm.graph import components

SHINGLE = 5
#: most holders of a shingle that a map batch sends by shingle, and that all batches together may send of one
HOT, HOLDERS = 16, 1_000_000
#: a class of more than 1 of this many rows is broadcast to its members
HEAVY = 4096
FLUSH_BYTES = 12_000_000
#: bounds of one block of a candidate cluster: shingles and documents; and documents of a part of what is left over
BLOCK_TOKENS, BLOCK_DOCS, PART_DOCS = 1_000_000, 400, 1_500
_LOW48 = np.uint64((1 << 48) - 1)


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of at least 75 %, in integers."""
    return 100 * overlap >= 75 * (a + b - overlap)


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice, text by text in hash order, and each text's number of them."""
    words = ws.scan(offsets, data, ws.SPACED)
    counts = np.diff(words.first)
    made = ws.grams(words.hash, SHINGLE)
    texts = np.arange(len(counts))
    n = np.maximum(counts - SHINGLE + 1, 0)
    owner = np.repeat(texts, n)
    hashes = made[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - words.first[:-1], n)] if len(owner) else np.zeros(0, np.uint64)
    for k in range(1, SHINGLE):  # fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(counts == k)
        if len(short):
            h = words.hash[words.first[short]].copy()
            for j in range(1, k):
                h = h * np.uint64(0xD1342543DE82EF95) + words.hash[words.first[short] + j]
            owner, hashes = np.append(owner, short), np.append(hashes, ws.mix(h + np.uint64(k)))
    order = np.lexsort((hashes & _LOW48, owner))
    owner, hashes = owner[order], hashes[order]
    if len(owner):
        first = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))
        owner, hashes = owner[first], hashes[first]
    return hashes, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def class_keys(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the name of each set; equal sets have equal names."""
    full = n > 0
    at = (np.cumsum(n) - n)[full]
    key, other = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(at):
        a = np.add.reduceat(ws.mix(hashes), at)
        b = np.add.reduceat(ws.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), at)
        size = n[full].astype(np.uint64)
        key[full], other[full] = ws.mix(a + ws.mix(b + size)), ws.mix(b ^ ws.mix(a + size))
    return key, other


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _split(block: np.ndarray, blocks: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(block, columns...) with the entries of each block that has some."""
    order = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[order], np.arange(blocks + 1))
    columns = tuple(c[order] for c in columns)
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), *(c[ends[b] : ends[b + 1]] for c in columns)


def _block_of(tokens: np.ndarray, blocks: int) -> np.ndarray:
    return ((ws.mix(tokens) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _need(n: np.ndarray) -> np.ndarray:
    return -(-n // 4)


_MAPPED = "block int, kind int, tokens binary, classes binary, extra binary"
#: kinds: token entries (tokens, classes, holders in the batch), hot holders (same), home rows (classes; extra: rows of the columns of HOME)
_ENTRY, _HELD, _HOME = 0, 1, 2


#: what a home row has for each document: its id and whether there is one, its number of shingles, the other half of its class's name, a mark of its text
HOME = ("doc_id", "known", "n", "other", "mark")


def _mapped(blocks: int, hot_holders: int, flush_bytes: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        key, columns, tokens, owner = (np.concatenate(x) for x in zip(*rows, strict=True))
        out: list[tuple] = []
        home = (key % np.uint64(blocks)).astype(np.int64)
        for b, k, x in _split(home, blocks, key, columns):
            out.append((b, _HOME, b"", k.tobytes(), x.tobytes()))
        classes = key[owner]
        order = np.lexsort((classes, tokens))
        tokens, classes = tokens[order], classes[order]
        if len(tokens):
            new = np.append(True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1]))
            tokens, classes = tokens[new], classes[new]
            starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            holders = np.diff(np.append(starts, len(tokens)))
            hot = np.repeat(holders > hot_holders, holders)
            for b, t, c in _split((classes[hot] % np.uint64(blocks)).astype(np.int64), blocks, tokens[hot], classes[hot]):
                out.append((b, _HELD, _pack48(t), c.tobytes(), b""))
            marks = tokens[starts[holders > hot_holders]]
            for b, t in _split(_block_of(marks, blocks), blocks, marks):
                out.append((b, _ENTRY, _pack48(t), b"", b""))  # no classes: the shingle is hot
            tokens, classes = tokens[~hot], classes[~hot]
            order = np.argsort(classes, kind="stable")
            tokens, classes = tokens[order], classes[order]
            for b, t, c in _split(_block_of(tokens, blocks), blocks, tokens, classes):
                at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                out.append((b, _ENTRY, _pack48(t), c[at].tobytes(), np.diff(np.append(at, len(c))).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "kind", "tokens", "classes", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, docs = [], 0, 0
        for batch in batches:
            ids, text, mark = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, at, data in ws.slices(text, 1_000_000):
                hashes, n = shingle_sets(at, data)
                key, other = class_keys(hashes, n)
                half = -(-n // 2)
                rank = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
                least = rank < np.repeat(half, n)
                part = ids.slice(lo, hi - lo)
                whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
                columns = np.stack([whole(part.fill_null(0)), whole(part.is_valid()), n, other.view(np.int64), whole(mark.slice(lo, hi - lo))], axis=1)
                rows.append((key, columns, hashes[least] & _LOW48, np.repeat(np.arange(hi - lo), n)[least] + docs))
                size, docs = size + len(data), docs + hi - lo
                if size >= flush_bytes:
                    yield flush(rows)
                    rows, size, docs = [], 0, 0
        if rows:
            yield flush(rows)

    return run


_REPLY = "block int, tokens binary, classes binary, ranks binary, home binary"


def _counted(blocks: int):
    """A shingle block: tells each class which of its shingles another class has too, and how common they are."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for r in pdf[pdf.kind == _HOME].itertuples():
            out.append((key[0], None, r.classes, None, r.extra))
        for r in pdf[pdf.kind == _HELD].itertuples():
            out.append((key[0], r.tokens, r.classes, b"", None))
        rows = pdf[pdf.kind == _ENTRY]
        if len(rows):
            marks = rows.classes.str.len() == 0
            hot = np.unique(_unpack48(list(rows.tokens[marks]))) if marks.any() else np.zeros(0, np.uint64)
            rows = rows[~marks]
            tokens = _unpack48(list(rows.tokens))
            classes = np.repeat(np.frombuffer(b"".join(rows.classes), np.uint64), np.frombuffer(b"".join(rows.extra), "<u4"))
            order = np.lexsort((classes, tokens))
            tokens, classes = tokens[order], classes[order]
            if len(tokens):
                new = np.append(True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1]))
                tokens, classes = tokens[new], classes[new]
                starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
                df = np.diff(np.append(starts, len(tokens)))
                rank = np.floor(np.log2(df)).astype(np.uint8)
                if len(hot):
                    rank[np.isin(tokens[starts], hot)] = 255
                df, rank = np.repeat(df, df), np.repeat(rank, df)
                keep = (df > 1) | (rank == 255)
                for b, t, c, k in _split((classes[keep] % np.uint64(blocks)).astype(np.int64), blocks, tokens[keep], classes[keep], rank[keep]):
                    out.append((b, _pack48(t), c.tobytes(), k.tobytes(), None))
        return pd.DataFrame(out, columns=["block", "tokens", "classes", "ranks", "home"])

    return run


_CANDIDATE = "doc_id long, class long, n long, other long, mark long, block int, tokens binary, classes binary, a long, b long"


def _named(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The class of each row: its key, or for sets that differ but share a key, the key and the other half mixed (the least other half keeps it)."""
    order = np.lexsort((other, key))
    k, o = key[order], other[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    least = np.repeat(o[first], np.diff(np.append(first, len(k))))
    out = key.copy()
    out[order] = np.where(o == least, k, ws.mix(k ^ ws.mix(o)))
    return out


def _stars_of(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs of the least holder of a shingle and another holder, shingles, the least holder of each)."""
    order = np.lexsort((classes, tokens))
    tokens, classes = tokens[order], classes[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    hub = np.repeat(classes[starts], np.diff(np.append(starts, len(tokens))))
    pairs = np.unique(np.stack([hub, classes], 1)[hub != classes], axis=0)
    return pairs, tokens[starts], classes[starts]


def _bounded(blocks: int):
    """A class block: applies the size-derived bound, returns the documents' rows, stars of the shingles that remain, and their middles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf[pdf.home.notna()]
        key = np.frombuffer(b"".join(home.classes), np.uint64)
        columns = np.frombuffer(b"".join(home.home), np.int64).reshape(-1, len(HOME))
        size, other = columns[:, 2], columns[:, 3]
        name = _named(key, other.view(np.uint64)).view(np.int64)
        out = [pd.DataFrame({"doc_id": pd.arrays.IntegerArray(columns[:, 0].copy(), columns[:, 1] == 0), "class": name, "n": size, "other": other, "mark": columns[:, 4]})]
        rows = pdf[pdf.home.isna()]
        if len(rows):
            # of each key its classes, and the least size among them: where a key has several, all get its shingles, which is more than they have
            _, first = np.unique(name, return_index=True)
            order = first[np.lexsort((name[first], key[first]))]
            keys, begin = np.unique(key[order], return_index=True)
            least = np.minimum.reduceat(size[order], begin)
            several = np.diff(np.append(begin, len(order)))
            tokens = _unpack48(list(rows.tokens))
            classes = np.frombuffer(b"".join(rows.classes), np.uint64)
            rank = np.concatenate([np.frombuffer(k, np.uint8) if len(k) else np.full(len(t) // 6, 255, np.uint8) for k, t in zip(rows.ranks, rows.tokens, strict=True)])
            by = np.lexsort((tokens, rank, classes))
            tokens, classes = tokens[by], classes[by]
            new = np.append(True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1]))
            tokens, classes = tokens[new], classes[new]
            starts = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
            shared = np.diff(np.append(starts, len(classes)))
            left = shared - _need(least[np.searchsorted(keys, classes[starts])]) + 1
            keep = np.arange(len(classes)) - np.repeat(starts, shared) < np.repeat(left, shared)
            tokens, at = tokens[keep], np.searchsorted(keys, classes[keep])
            times = several[at]
            owner = name[order][np.repeat(begin[at] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            pairs, tokens, middle = _stars_of(np.repeat(tokens, times), owner)
            out.append(pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}))
            sent = [(b, _pack48(t), c.tobytes()) for b, t, c in _split(_block_of(tokens, blocks), blocks, tokens, middle)]
            out.append(pd.DataFrame(sent, columns=["block", "tokens", "classes"]))
        # nullable integers throughout: keys have 64 bits, which a float column would round
        columns = {"doc_id": "Int64", "class": "Int64", "n": "Int64", "other": "Int64", "mark": "Int64", "block": "Int64", "tokens": object, "classes": object, "a": "Int64", "b": "Int64"}
        return pd.concat([x.reindex(columns=list(columns)).astype(columns) for x in out])

    return run


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    pairs, _, _ = _stars_of(_unpack48(list(pdf.tokens)), np.frombuffer(b"".join(pdf.classes), np.int64))
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, class, chunks, hub, other, text) -> its set, if the text has the set that is looked for."""
    for batch in batches:
        for lo, hi, at, data in ws.slices(batch.column("text"), 1_000_000):
            hashes, n = shingle_sets(at, data)
            _, other = class_keys(hashes, n)
            part = batch.slice(lo, hi - lo)
            ends = np.cumsum(n)
            keep = np.flatnonzero(other.view(np.int64) == part.column("other").to_numpy())
            names = ["cluster", "class", "chunks", "hub"]
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(keep)) for c in names], pa.array([hashes[ends[i] - n[i] : ends[i]].tobytes() for i in keep], pa.binary())], names=[*names, "tokens"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix with its transpose: overlap counts of all pairs of at most a few thousand sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    keep = df[column] > 1
    column, row = column[keep], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    starts = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(column)))
    counts = np.zeros((m, m), np.float32)
    few = 24 if m > 24 else 0
    for d in np.unique(length[length <= few]):  # rare shingles: add their pairs
        at = row[starts[length == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(counts, (at[:, i], at[:, j]), 1)
    counts += counts.T
    many = np.flatnonzero(length > few)
    for lo in range(0, len(many), 2048):  # common ones: a dense slab of columns at a time
        slab = many[lo : lo + 2048]
        dense = np.zeros((m, len(slab)), np.float32)
        for_column = np.repeat(np.arange(len(slab)), length[slab])
        dense[row[np.repeat(starts[slab] - (np.cumsum(length[slab]) - length[slab]), length[slab]) + np.arange(len(for_column))], for_column] = 1
        counts += dense @ dense.T
    return counts


def _forest(classes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The place of the least class that each class reaches by links among these sets."""
    n = np.array([len(s) for s in sets], np.float64)
    hit = linked(overlaps(sets).astype(np.float64), n[:, None], n[None, :])
    root = np.arange(len(sets))
    seen = np.zeros(len(sets), bool)
    for i in np.argsort(classes, kind="stable"):
        if not seen[i]:
            front = np.zeros(len(sets), bool)
            front[i] = True
            while front.any():
                seen |= front
                root[front] = i
                front = hit[front].any(axis=0) & ~seen
    return root


_LINK = "cluster long, a long, b long"


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within each cluster of a block; a class that does not reach the block's hub, if that is there, also comes without a partner."""
    out = []
    for cluster, group in pdf.groupby("cluster"):
        group = group.drop_duplicates("class")
        if len(group) > 1:
            classes, hub = group["class"].to_numpy(), np.flatnonzero(group["hub"].to_numpy())
            root = _forest(classes, [np.frombuffer(t, np.uint64) for t in group.tokens])
            tied = np.flatnonzero(root != np.arange(len(root)))
            out.append(pd.DataFrame({"cluster": cluster, "a": classes[tied], "b": classes[root[tied]]}))
            if len(hub):
                out.append(pd.DataFrame({"cluster": cluster, "a": classes[root != root[hub[0]]]}))
    columns = {"cluster": "Int64", "a": "Int64", "b": "Int64"}
    return pd.concat([x.reindex(columns=list(columns)).astype(columns) for x in out]) if out else pd.DataFrame(columns=list(columns)).astype(columns)


def _own(chunks: str = "chunks") -> Column:
    return F.pmod(F.hash("class"), F.col(chunks))


def _own_blocks(sets: DataFrame, blocks: int) -> DataFrame:
    """`sets` (cluster, class, chunks, hub, tokens) as dealt out to the blocks of their clusters: each to its own, the hub to all."""
    bin_ = F.when(F.col("chunks") == 1, F.pmod(F.hash("cluster"), F.lit(4 * blocks)).cast("long")).otherwise(F.col("cluster"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    hub = (F.col("hub") & (F.col("chunks") > 1)).alias("hub")
    return sets.select("cluster", "class", "tokens", "chunks", hub, bin_.alias("bin"), F.explode(F.when(F.col("hub"), every).otherwise(F.array(_own()))).alias("i"))


def _entries(sets: DataFrame) -> DataFrame:
    """cluster, class, n, token: a row for each shingle of each set of `sets` (cluster, class, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column("tokens")).to_numpy(zero_copy_only=False) // 8))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_TOKENS, "right")) - 1)
                part, n = batch.slice(lo, hi - lo), np.diff(ends[lo : hi + 1])
                repeated = [np.repeat(x, n) for x in (part.column("cluster").to_numpy(), part.column("class").to_numpy(), n)]
                tokens = np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*repeated, tokens)], names=["cluster", "class", "n", "token"])
                lo = hi

    return sets.select("cluster", "class", "tokens").mapInArrow(run, "cluster long, class long, n long, token long")


def _prefixes(over: DataFrame, again: DataFrame) -> DataFrame:
    """cluster, class, token: of each class of `over` that may link within its cluster of `again`, some shingles one of which any partner has.

    A linked class has 3/4 of each partner's shingles, so a class with fewer that another one has can't link; of the others, all but
    3/4 of its shingles and one more, the rarest of the cluster, are enough, on both sides of a link.
    """
    shared = _entries(again).groupBy("cluster", "token").agg(F.count("*").alias("holders")).where("holders > 1")
    own = _entries(over).join(shared, ["cluster", "token"])
    rarest = Window.partitionBy("class").orderBy("holders", "token")
    own = own.withColumns({"rank": F.row_number().over(rarest), "shared": F.count("*").over(Window.partitionBy("class"))})
    return own.where("rank <= shared - ceil(3 * n / 4) + 1").select("cluster", "class", "token")


def _left_over(sets: DataFrame, left: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of several blocks that have classes `left` (cluster, class), which did not reach the hub, as (bin, i, j, cluster, class, tokens, hub) to multiply; and the two tables that this reads.

    Shingles of whole sets part what is left over into clusters of their own; a class that reached the hub goes to each of these
    that it shares such a shingle with. A cluster's left-over classes go in parts to all blocks of it.
    """
    # a few clusters at most, but their sets are read several times
    again = saved(sets.where("chunks > 1").join(left.select("cluster").distinct(), "cluster", "left_semi").select("cluster", "class", "tokens"), "again")
    prefix = saved(_prefixes(again.join(left.select("class"), "class", "left_semi"), again), "prefixes")
    least = prefix.groupBy("cluster", "token").agg(F.min("class").alias("least"))
    root = components(prefix.join(least, ["cluster", "token"]).select(F.col("class").alias("a"), F.col("least").alias("b")))
    own = prefix.select("class").distinct().join(root.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("narrow"))
    own = saved(own, "narrow")
    # all left-over classes with a shingle among these are in one narrow cluster
    of = saved(least.join(own, F.col("least") == F.col("class")).select("cluster", "token", "narrow"), "tokens")
    marks = saved(key_marks(of.select(F.xxhash64("cluster", "token").alias("key"))), "marks")
    reached = _entries(again.join(left.select("class"), "class", "left_anti"))
    asked = only_marked(reached, F.xxhash64("cluster", "token"), marks).select("cluster", "class", "token")
    partners = asked.join(of, ["cluster", "token"]).select("class", "narrow").distinct()
    member = own.withColumn("over", F.lit(True)).unionByName(partners.withColumn("over", F.lit(False)))
    whole = saved(again.select("class", "tokens").join(member, "class").select(F.col("narrow").alias("cluster"), "class", "tokens", "over"), "whole")
    size = whole.groupBy("cluster").agg(F.sum(F.length("tokens") / 8).alias("n"), F.count("*").alias("docs"), F.count_if("over").alias("lefts")).where("docs > 1")
    chunks = F.ceil(F.greatest(F.col("n") / BLOCK_TOKENS, F.col("docs") / BLOCK_DOCS)).cast("int")
    size = saved(size.select("cluster", chunks.alias("chunks"), F.ceil(F.col("lefts") / PART_DOCS).cast("int").alias("parts")), "parts")
    discard(again, prefix, own, of, marks)
    small = (F.col("chunks") == 1) & (F.col("parts") == 1)
    bin_ = F.when(small, F.pmod(F.hash("cluster"), F.lit(4 * blocks)).cast("long")).otherwise(F.col("cluster"))
    dealt = whole.join(size, "cluster").select("cluster", "class", "tokens", "chunks", "parts", "over", F.lit(False).alias("hub"), bin_.alias("bin"))
    names = ["bin", "chunks", "parts", "cluster", "class", "tokens", "hub"]
    here = dealt.select(*names, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), _own().alias("j"))
    others = F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), _own())
    over = dealt.where("over").select(*names, F.pmod(F.hash("class", F.lit(1)), F.col("parts")).alias("i"), F.explode(others).alias("j"))
    return here.unionByName(over), whole, size


def _links(sets: DataFrame, blocks: int) -> DataFrame:
    """a, b: spanning forests of the links among `sets`, one row a class."""
    first = saved(_own_blocks(sets, blocks).groupBy("bin", "chunks", "i").applyInPandas(_product, _LINK), "links")
    links, left = first.where("b is not null").select("a", "b"), first.where("b is null").select("cluster", F.col("a").alias("class"))
    if left.isEmpty():
        return links
    dealt, whole, size = _left_over(sets, left, blocks)
    second = saved(dealt.groupBy("bin", "chunks", "parts", "i", "j").applyInPandas(_product, _LINK), "links")
    discard(whole, size)
    return links.unionByName(second.select("a", "b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id long, text string; other columns are ignored).

    See the module for the method and for the cases.  An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    blocks = partitions(docs)
    batches = 1 + blocks * BLOCK_BYTES // FLUSH_BYTES
    mapped = docs.mapInArrow(_mapped(blocks, min(HOT, max(1, HOLDERS // batches)), FLUSH_BYTES), _MAPPED)
    reply = mapped.groupBy("block").applyInPandas(_counted(blocks), _REPLY)
    bounded = saved(reply.groupBy("block").applyInPandas(_bounded(blocks), _CANDIDATE), "shingles")
    member = bounded.where("class is not null").select("doc_id", "class", "n", "other", "mark")
    stars = saved(bounded.where("block is not null").groupBy("block").applyInPandas(_stars, "a long, b long").unionByName(bounded.where("a is not null").select("a", "b")), "stars")
    cluster = components(stars).selectExpr("node class", "root cluster")
    # one text of each class: id and mark find it, as a null or repeated id has others
    one = member.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "mark", "n", "other")).alias("x"))
    rep = one.select("class", F.col("x.doc_id").alias("wanted"), F.col("x.mark").alias("marked"), "x.n", "x.other").join(cluster, "class")
    middle = stars.groupBy(F.col("a").alias("class")).agg(F.count("*").alias("star"))
    size = rep.join(middle, "class", "left").groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"), F.max(F.struct(F.coalesce("star", F.lit(0)), "class"))["class"].alias("top"))
    size = saved(size.select("cluster", "top", F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("docs") / BLOCK_DOCS)).cast("int").alias("chunks")), "clusters")
    rep = saved(rep.join(size, "cluster").selectExpr("cluster", "class", "chunks", "class = top hub", "other", "wanted", "marked"), "wanted")
    # a text that no class asks for is not shuffled to find that out, but for some that share a mark's class
    marks = saved(key_marks(rep.select(F.xxhash64("wanted", "marked").alias("key"))), "marks")
    asked = only_marked(docs, F.xxhash64("doc_id", "mark"), marks)
    texts = asked.join(rep.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("wanted")) & (F.col("mark") == F.col("marked")))
    sets = texts.select("cluster", "class", "chunks", "hub", "other", "text").mapInArrow(_sets_of, "cluster long, class long, chunks int, hub boolean, tokens binary")
    sets = saved(sets.dropDuplicates(["class"]), "sets")
    links = saved(_links(sets, blocks), "links")
    discard(sets, stars, size, rep, marks)
    # a class's name is its least id, a component's the least name of its classes. Each step is written, so that the joins read
    # plain exchanges, which adaptive execution can split where one class or component is large
    first = saved(member.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")), "classes")
    rows = first.agg(F.sum("members")).first()[0] or 0
    several = saved(components(links).selectExpr("node class", "root").join(first, "class"), "members")
    top = saved(several.groupBy("root").agg(F.min("least").alias("top")), "tops")
    name = first.join(several.join(top, "root").select("class", "top"), "class", "left").select("class", F.coalesce("top", "least").alias("component_id"), (F.col("members") * HEAVY > rows).alias("heavy"))
    name = saved(name, "names")
    discard(links, first, several, top)
    # the members of a class were written by one task, so no split of an exchange parts them: classes of more than 1 of HEAVY
    # rows, which are fewer than that, are broadcast to their members
    heavy, light = F.broadcast(name.where("heavy").drop("heavy")), name.where("not heavy").drop("heavy")
    own = member.where("n > 0")
    named = own.join(heavy, "class").unionByName(own.join(heavy.select("class"), "class", "left_anti").join(light, "class"))
    alone = member.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return named.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their component: of each the one with the least doc_id, all columns kept.

    Of rows that repeat both id and text one stays; an id with several texts stays if one of them stands for its component.
    A row without an id or without words stays.
    """
    found = jaccard_components(docs).where("component_id is not null and n_shingles > 0")
    by_id = saved(found.groupBy(F.col("doc_id").alias("own")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows")), "components")
    own = F.col("doc_id").cast("long") == F.col("own")
    # the small side is built into a table per task, so texts are shuffled but never sorted
    left = docs.join(by_id.where("not first or rows > 1").select("own").hint("shuffle_hash"), own, "left_anti")
    several = docs.join(by_id.where("first and rows > 1").select("own").hint("shuffle_hash"), own, "left_semi")
    place = Window.partitionBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy(F.xxhash64(*docs.columns))
    several = several.select(F.struct("*").alias("row"), F.row_number().over(place).alias("place")).where("place = 1").select("row.*")
    return left.unionByName(several)
