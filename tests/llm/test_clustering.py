"""Centroid clustering against a plain version, and its edges."""

import hashlib
import math

import numpy as np
import pytest

from mortise.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds):
    """rows: (id, integer components). The contract, in Python integers."""
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)[:k]
    cents = [list(x) for _, x in starts]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents))[1]

    for _ in range(rounds):
        where = [near(x) for _, x in rows]
        for n in range(len(cents)):
            own = [x for (_, x), w in zip(rows, where) if w == n]
            if own:
                cents[n] = [sum(v) // len(own) for v in zip(*own)]
    out = []
    for i, x in rows:
        n = near(x)
        out.append((i, n, sum((a - b) ** 2 for a, b in zip(x, cents[n]))))
    by = [sum(d for _, m, d in out if m == n) for n in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, by[n], sum(by), sha[n]) for i, n, d in out), key=str)


@pytest.mark.parametrize(("k", "rounds", "seed"), [(8, 10, 0), (8, 10, 1), (3, 1, 2), (5, 0, 3), (30, 4, 4)])
def test_equals_plain(spark, k, rounds, seed):
    r = np.random.default_rng(seed)
    x = (r.normal(0, 1, (120, 6)) + r.integers(0, 3, (120, 1))).astype(np.float32)
    x[50:90] = x[50]  # many copies, so ties and empty centroids
    data = [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)]
    whole = [(i, [math.floor(1024 * v) for v in row]) for i, row, _ in data]
    got = clustering.cluster(spark.createDataFrame(data, SCHEMA).repartition(3), k=k, dims=6, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(whole, k, rounds)


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a = sorted(map(tuple, clustering.cluster(df.repartition(1)).collect()))
    assert a == sorted(map(tuple, clustering.cluster(df.repartition(17)).collect())) and len(a) == df.count()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [], 0), (3, [1.0], 0), (4, [1.0, 2.0, 3.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [1.0, -inf], 0)]
    assert clustering.cluster(spark.createDataFrame(bad, SCHEMA), dims=2).collect() == []
    assert clustering.cluster(spark.createDataFrame([], SCHEMA), dims=2).collect() == []
    good = [(None, [0.5, -0.0001], 0), (9, [0.5, 0.25], 0), (9, [0.5, 0.25], 0), (9, [0.25, 0.25], 0), (8, [3e38, -3e38], 0)]
    got = clustering.cluster(spark.createDataFrame(bad + good, SCHEMA), dims=2, rounds=3).collect()
    big = 2**27
    assert sorted(map(tuple, got), key=str) == plain([(None, [512, -1]), (9, [512, 256]), (9, [512, 256]), (9, [256, 256]), (8, [big, -big])], 8, 3)
    extra = spark.createDataFrame([(1, [1.0, 2.0], 5, "a", 7)], "vec_id int, embedding array<double>, cluster int, x string, dots int")
    assert [(r.vec_id, r.cluster, r.distance) for r in clustering.cluster(extra, dims=2).collect()] == [(1, 0, 0)]
    only_null = spark.createDataFrame([(None, [1.0, 2.0], 0)], SCHEMA)
    assert clustering.cluster(only_null, dims=2).collect() == []
