import hashlib
import random

import numpy as np
import pytest

from quern.llm import centroids
from tests.compare import connect, differences
from quern.llm.oracles import _clustering

SCHEMA = "vec_id long, embedding array<float>, x string, cluster int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "s", 1) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)], SCHEMA)


def plain(x, c):
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def brute(vectors, ids, k, rounds, dims, seed=3):
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, int(np.floor(1024 * float(np.float32(y)))))) for y in v]) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) == dims and all(y is not None and np.isfinite(np.float32(y)) for y in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    now = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    at = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = [at(x)[1] for _, x in kept]
        now = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [x for (_, x), o in zip(kept, own, strict=True) if o == n]) else c for n, c in enumerate(now)]
    last = [at(x) for _, x in kept]
    inertia = {n: sum(d for d, m in last if m == n) for n in range(k)}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True)), key=str)


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def clumps(n, dims, seed):
    rnd = random.Random(seed)
    at = [[rnd.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    return [[c + rnd.gauss(0, 0.4) for c in rnd.choice(at)] for _ in range(n)]


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 1), (1, 2), (8, 0)])
def test_against_brute_force(spark, k, rounds):
    vectors = clumps(150, 6, k)
    assert result(centroids.digests(frame(spark, vectors), k, rounds, 6)) == brute(vectors, range(150), k, rounds, 6)


def test_search_is_exact_and_compares_fewer():
    rng = np.random.default_rng(2)
    for spread, k, dims in ((1, 8, 64), (50, 200, 3), (1000, 64, 2), (0, 5, 4)):
        c = rng.integers(-1000, 1000, (k, dims)) * rng.integers(1, spread + 2, (k, 1))
        x = np.concatenate([c[rng.integers(0, k, 700)] + rng.integers(-9, 9, (700, dims)), rng.integers(-3000, 3000, (300, dims))])
        number, distance, needed = centroids.nearest(x, c)
        want = plain(x, c)
        assert (number == want[0]).all() and (distance == want[1]).all()
        assert needed <= len(x) * k and (spread < 50 or needed < len(x) * k / 3)


def test_ties_on_the_border_of_the_annulus():
    # all on a line through the origin: the far one's norm lies on the border of the annulus, and the distances are equal
    assert [a.tolist() for a in centroids.nearest(np.array([[3, 0], [0, 3]]), np.array([[5, 0], [1, 0]]))[:2]] == [[0, 1], [4, 10]]
    assert [a.tolist() for a in centroids.nearest(np.array([[3, 0]]), np.array([[1, 0], [5, 0]]))[:2]] == [[0], [4]]
    big = centroids.LIMIT - 4
    assert [a.tolist() for a in centroids.nearest(np.array([[big + 2, 0]]), np.array([[big + 4, 0], [big, 0], [big, 0]]))[:2]] == [[0], [4]]
    same = np.array([[7, 7], [7, 7], [-7, -7], [7, -7]])
    assert centroids.nearest(np.array([[7, 7], [0, 0], [0, -9]]), same)[0].tolist() == [0, 0, 2]


def test_odd_vectors_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0], [1.0, nan], [inf, 1.0], [None, 1.0], [1.0, 2.0, 3.0], [-0.0004, 0.0004], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [-1.0, -1.0], [3e38, -3e38], [0.5, 0.25], [9.0, 9.0]]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None, None, 12, 13, 14]
    df = frame(spark, vectors, ids)
    for k in (2, 8, 20):
        assert result(centroids.digests(df, k, 4, 2)) == brute(vectors, ids, k, 4, 2)


def test_an_empty_cluster_stays(spark):
    vectors = [[0.0, 0.0]] * 6 + [[1.0, 1.0]] * 3
    assert result(centroids.digests(frame(spark, vectors), 8, 3, 2)) == brute(vectors, range(9), 8, 3, 2)


def test_empty_table_and_no_whole_vector(spark):
    for df in (frame(spark, []), frame(spark, [None, [1.0]])):
        out = centroids.digests(df)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_same_at_any_partitioning(spark):
    df = frame(spark, clumps(300, 4, 9))
    assert result(centroids.digests(df.repartition(1), 8, 5, 4)) == result(centroids.digests(df.repartition(9), 8, 5, 4))


def test_other_parameters_against_sql(spark, sf_dir):
    from quern.llm.common import table

    assert not differences(centroids.digests(table(spark, sf_dir, "embeddings"), 5, 2, 64, 9), connect(sf_dir), _clustering(5, 2, 64, 9))
