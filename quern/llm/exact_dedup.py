r"""Exact deduplication (operator 11) by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Texts are equal when they are identical without the characters of
`[\x20\x09-\x0D]`.  A first pass keeps two numbers of each row, the length of
the bare text and a hash of its first :data:`PREFIX` characters and that length.
Rows whose length no other row has are done; of the others, rows whose prefix
hash no other has.  A second pass hashes whole texts, but only of rows that may
still have an equal; these alone are grouped, by the whole hash (SHA-256).

What the second pass has to know of all prefix hashes is one bit for each of
2^26 classes of them (`common.KEY_CLASSES`), whether a class holds a hash that two rows share.
So what is broadcast has a fixed size and texts are never shuffled for the test:
a text that is let through for another one's sake is hashed for nothing and
then stands alone.  Lengths of :data:`LISTED` characters and more are taken as
shared, so the list of lengths is bounded too.  Counts combine before they are
shuffled.  Groups that hold more than 1 of :data:`HEAVY` hashed rows, of which
there are fewer than that, are broadcast to their rows; all others meet theirs
in a shuffle of hashes.

Of a group, the row with the most characters of original text stays, of these
the one with the least doc_id (null last), of these one.

Defined results: a null text is empty, and empty texts are equal.  Repeated rows
are copies of each other: one stays, and all name its doc_id.  An empty table
gives no rows.  Texts of any length are read whole.  Extra columns are kept
unless a result column has the name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, key_marks, saved, with_mark

#: characters that don't count
BLANKS = " \t\n\x0b\x0c\r"
PREFIX = 64
LISTED = 1 << 20
HEAVY = 4096
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def bare(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _sketched(docs: DataFrame, *more: Column) -> DataFrame:
    """`more`, the bare text, its length, and `head`, a hash of the length and the first characters."""
    df = docs.select(*more, bare(F.col("text")).alias("bare"))
    return df.select("*", F.length("bare").alias("length")).withColumn("head", F.xxhash64("length", F.substr("bare", F.lit(1), F.lit(PREFIX))))


def shared_lengths(sketches: DataFrame) -> DataFrame:
    """Lengths under LISTED that several rows of `sketches` (length, head) have."""
    return sketches.where(F.col("length") < LISTED).groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")


def shared_heads(sketches: DataFrame) -> DataFrame:
    """The prefix hashes (key) that several rows of a shared length have."""
    known = sketches.where(F.col("length") < LISTED).join(F.broadcast(shared_lengths(sketches)), "length", "left_semi")
    left = known.unionByName(sketches.where(F.col("length") >= LISTED))
    return left.groupBy(F.col("head").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")


def exact_groups(docs: DataFrame, keep: Sequence[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns `keep` (else all) of each row of `docs` with keep_id, group_size, kept and text_sha256.

    The hash of a row that stands alone is null, as nothing needs it; `digests` asks for it too.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    sketches = saved(_sketched(docs).select("length", "head"), "sketches")
    marks = saved(key_marks(shared_heads(sketches)), "heads")
    rows = _sketched(docs, F.struct(*keep).alias("all"), "doc_id", F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"))
    rows = with_mark(rows, F.col("head"), marks, "again")
    digest = F.sha2("bare", 256)
    rows = rows.select("all", "doc_id", "chars", "again", (digest if digests else F.when(F.col("again"), digest)).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = saved(rows, "hashed")
    discard(sketches, marks)

    some = rows.where("again")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.isnull("doc_id").alias("nameless"), "doc_id", "row"))
    groups = saved(some.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    hashed = groups.agg(F.sum("group_size")).first()[0] or 0
    is_heavy = F.col("group_size") * HEAVY > hashed
    heavy, light = groups.where(is_heavy), groups.where(~is_heavy)
    many = some.join(F.broadcast(heavy), "text_sha256")
    few = some.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti").join(light, "text_sha256")
    told = many.unionByName(few).select("all", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
    alone = rows.where("!again").select("all", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(told).select(*[F.col("all")[c].alias(c) for c in keep], *RESULTS)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay."""
    whole = exact_groups(docs.select(F.struct("*").alias("whole"), "doc_id", "text"), ["whole"])
    return whole.where("kept").select(*[F.col("whole")[c].alias(c) for c in docs.columns])
