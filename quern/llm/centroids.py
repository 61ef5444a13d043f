"""Centroid clustering (operator 13): Lloyd's rounds on integer vectors, assignment by annulus search.

By the triangle inequality a centroid c within u of a vector x has a norm within
u of x's.  Centroids are sorted by norm.  The distance to the nearer of the two
whose norms stand next to x's is an upper bound u; two binary searches find the
centroids with norms in the annulus from norm(x) - u to norm(x) + u, and only
these are compared, exactly.  The annulus is widened by more than the rounding
of its norms, so a centroid on its border, which may tie, is always compared.
Ties go to the smaller number.

All else is integers: components are floor(1024 * x), a centroid's are the floor
of sum by count.  So results depend neither on partitions nor on the order of
additions, and a lost task is done again with the same result.

A round is one scan.  Each task adds up its vectors by cluster and sends at most
one row a cluster; the centroids themselves (clusters x components numbers,
bounded by the parameters) are all that the driver holds.  Rounds end early
where no centroid moves, as nothing would change after that.  A chunk of a batch
compares :data:`PAIRS` numbers at a time.

Defined results: vectors that are null, have another number of components, or
null or non-finite ones are left out.  Integers beyond :data:`LIMIT` either way
count as that, so that a distance fits 64 bits; an inertia that does not is the
largest of these.  Repeated rows count each; of equal names the lesser vector is
the first centroid.  A null vec_id has the name of an empty one.  Of fewer vectors
than clusters each starts one.  An empty table gives no rows.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, saved

SCALE, LIMIT = 1024, 1 << 27
PAIRS = 1 << 21
#: relative width added to the annulus; norms are exact to about 2 ** -52
SLACK = 1e-9
_MOST = (1 << 63) - 1


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each vector's nearest centroid, squared distance, and how many distances were needed. Both are int64."""
    norm = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
    order = np.argsort(norm, kind="stable")
    norm, ranked = norm[order], centroids[order]
    number, distance, needed = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    step = max(1, PAIRS // (max(1, x.shape[1]) * len(centroids)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        own = np.sqrt((part * part).sum(axis=1).astype(np.float64))
        after = np.searchsorted(norm, own)
        near = np.minimum(_squared(part, ranked[np.maximum(after - 1, 0)]), _squared(part, ranked[np.minimum(after, len(norm) - 1)]))
        bound = np.sqrt(near.astype(np.float64))
        slack = SLACK * (own + bound + 1)
        first = np.searchsorted(norm, own - bound - slack, side="left")
        last = np.searchsorted(norm, own + bound + slack, side="right")
        sizes = last - first
        begin = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(part)), sizes)
        at = np.arange(len(row)) - begin[row] + first[row]
        d = _squared(part[row], ranked[at])
        least = np.minimum.reduceat(d, begin)
        number[lo : lo + step] = np.minimum.reduceat(np.where(d == least[row], order[at], len(order)), begin)
        distance[lo : lo + step] = least
        needed += len(row)
    return number, distance, needed


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            own = nearest(x, centroids)[0]
            for c in np.unique(own).tolist():
                total[c] += x[own == c].sum(axis=0)
            count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = nearest(_matrix(batch.column("x"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def scaled(df: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the integer components of each vector that is whole and finite."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return df.where((F.size(x) == dims) & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, held).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose names have the least hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    dims = centroids.shape[1]
    part = vectors.select("x").mapInArrow(_sums(centroids), "cluster long, n long, total array<long>")
    by = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in by.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return out


def _total(x: Column) -> Column:
    """A sum of longs as a long, the largest where it is beyond."""
    return F.least(F.sum(x.cast("decimal(20,0)")), F.lit(_MOST).cast("decimal(30,0)")).cast("long")


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components), a row a vector."""
    spark = df.sparkSession
    vectors = saved(scaled(df, dims, vector), "vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        empty = spark.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit(None).cast("array<long>").alias("centroid"))
    for _ in range(rounds):
        before, centroids = centroids, moved(vectors, centroids)
        if (before == centroids).all():
            break
    labels = saved(vectors.mapInArrow(_labels(centroids), schema), "labels")
    discard(vectors)
    known = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    by = labels.groupBy("cluster").agg(_total(F.col("distance")).alias("cluster_inertia")).join(F.broadcast(known), "cluster")
    return labels.join(F.broadcast(by), "cluster").crossJoin(F.broadcast(labels.agg(_total(F.col("distance")).alias("inertia")))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def digests(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """`cluster` with centroid_sha256 instead of the centroid."""
    return cluster(df, k, rounds, dims, seed).withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")
