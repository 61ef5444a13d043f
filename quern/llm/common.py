"""Helpers of the corpus operators: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import folder as scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lost executor costs no recomputation of what lies before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `saved` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: blocks that a table is dealt into: one for this many bytes, up to a number that keeps what one task sends to each worthwhile
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 100_000


def partitions(df: DataFrame) -> int:
    """Blocks to deal `df` into: by the size that the optimizer expects, and no fewer than the session's shuffle partitions."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BLOCKS, expected // BLOCK_BYTES if expected < 1 << 60 else 0))


#: classes of 64-bit keys, a bit for each: what is broadcast to tell whether a key may be wanted is at most this many bits (8 MB, and about as much again for the rows that hold them)
KEY_CLASSES = 1 << 26
#: words of 64 bits in a row of them
PAGE = 8


def _place(key: Column) -> list[Column]:
    """Page, word of the page, and bit of the word of a key's class."""
    of = F.pmod(key, F.lit(KEY_CLASSES))
    return [F.floor(of / (64 * PAGE)).cast("int").alias("page"), (F.floor(of / 64) % PAGE).cast("int").alias("word"), (of % 64).cast("int").alias("bit")]


def key_marks(keys: DataFrame) -> DataFrame:
    """page, words: the bits of some classes in order, set where a key of `keys` (key long) is of the class; pages without any are left out."""
    words = keys.select(*_place(F.col("key"))).groupBy("page", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    pages = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known"))
    return pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0).cast("long"))).alias("words"))


def _marked(words: str) -> Column:
    return F.expr(f"(shiftright(get({words}, word), bit) & 1) = 1")


def with_mark(df: DataFrame, key: Column, marks: DataFrame, name: str) -> DataFrame:
    """`df` with a flag whether the class of `key` is marked: true for every key that is wanted, and for some others.

    The marks have a fixed size at most, so they are broadcast, and rows that can't be wanted need not be shuffled to find out.
    """
    df = df.select("*", *_place(key)).join(F.broadcast(marks), "page", "left")
    return df.withColumn(name, F.coalesce(_marked("words"), F.lit(False))).drop("page", "word", "bit", "words")


def only_marked(df: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """The rows of `df` that :func:`with_mark` flags; the join itself drops the others."""
    known = F.broadcast(marks.select(F.col("page").alias("known_page"), F.col("words").alias("known_words")))
    return df.select("*", *_place(key)).join(known, (F.col("page") == F.col("known_page")) & _marked("known_words"), "left_semi").drop("page", "word", "bit")
