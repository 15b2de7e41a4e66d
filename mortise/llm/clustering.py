"""Operator 11: k-means on integer vectors, with a matrix of dot products that is kept and only corrected.

Every vector carries its exact dot product with each centroid. When centroids move, a dot product is corrected by the centroid's
nonzero component changes alone, and the nearest centroid is found again from |c|^2 - 2 x.c. A round's sums are kept too, and
corrected by the vectors that changed their cluster. All numbers are 64-bit integers, so results don't depend on order.

The state (vector, dot products, cluster) is written each round to the shared folder and the one before it deleted: a lost executor costs
part of a round. What reaches the driver are k centroids and at most k x (dims + 1) sums.

A vector is kept if it has exactly `dims` components, none null, NaN or infinite. A component x becomes floor(scale * x), held within
+-2^27 so that squared distances fit 64 bits. Starts are the k kept vectors with the smallest sha256 of "3:<vec_id>"; rows that share
an id come in the order of their components; rows with a null id are clustered but start no centroid. Fewer than k such rows give fewer
centroids, and none (an empty table too) give an empty result. Repeated rows are clustered row by row. Ties go to the smaller number, and
an empty centroid stays where it is. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mortise.session import discard, materialise

LIMIT = 2.0**27
_STATE = "vec_id long, x array<long>, size2 long, dots array<long>, cluster int, was int"


def integers(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x, the kept vectors in integers."""
    good = (F.size(vec_col) == dims) & F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(vec_col, lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("x"))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _as_lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def assign(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids moved from old to new (k x dims each): dot products corrected, clusters found again."""
    k, dims = new.shape
    changes = [(at := np.flatnonzero(n - o), (n - o)[at]) for o, n in zip(old, new, strict=True)]
    norms = (new * new).sum(1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, dots = _lists(b.column("x"), dims), _lists(b.column("dots"), k).copy()
            for c, (at, delta) in enumerate(changes):
                if len(at):
                    dots[:, c] += x[:, at] @ delta
            near = (norms - 2 * dots).argmin(1).astype(np.int32)  # the first of equals
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), b.column("size2"), _as_lists(dots), pa.array(near), b.column("cluster")], names=["vec_id", "x", "size2", "dots", "cluster", "was"])

    return state.select("vec_id", "x", "size2", "dots", "cluster").mapInArrow(step, _STATE)


def moved_sums(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """k x (dims + 1): what the vectors that changed their cluster add to each cluster's component sums and, last, to its count."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = np.column_stack((_lists(b.column("x"), dims), np.ones(b.num_rows, dtype=np.int64)))
                for name, sign in (("cluster", 1), ("was", -1)):
                    where = b.column(name).to_numpy(zero_copy_only=False)
                    for c in np.unique(where[where >= 0]):
                        total[c] += sign * x[where == c].sum(0)
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[c, at])], names=["c", "at", "total"])

    parts = state.where("cluster <> was").select("x", "cluster", "was").mapInArrow(step, "c int, at int, total long")
    out = np.zeros((k, dims + 1), dtype=np.int64)
    for r in parts.groupBy("c", "at").agg(F.sum("total").alias("total")).collect():  # at most k x (dims + 1) rows
        out[r["c"], r["at"]] = r["total"]
    return out


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, salt: str = "3", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = integers(vectors, dims, scale, id_col, vec_col)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.where("vec_id is not null").orderBy(order, "x").limit(k).select("x").collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in starts], dtype=np.int64)
    k = len(centroids)
    size2 = F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e * e)
    state = kept.select("vec_id", "x", size2.alias("size2"), F.array_repeat(F.lit(0).cast("long"), k).alias("dots"), F.lit(-1).alias("cluster"))
    state = materialise(assign(state, np.zeros_like(centroids), centroids), "vectors")
    sums = np.zeros((k, dims + 1), dtype=np.int64)
    for _ in range(rounds):
        sums += moved_sums(state, k, dims)
        full = sums[:, -1] > 0
        moved = centroids.copy()
        moved[full] = sums[full, :-1] // sums[full, -1:]  # rounds down
        if (moved == centroids).all():
            break  # nothing would change in the rounds left
        after = materialise(assign(state, centroids, moved), "vectors")
        discard(state)
        state, centroids = after, moved
    norms, digests = (centroids * centroids).sum(1), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list) -> F.Column:
        return F.array(*map(F.lit, values))[F.col("cluster")]

    distance = F.col("size2") - 2 * F.col("dots")[F.col("cluster")] + of_cluster(norms.tolist()).cast("long")
    found = state.select("vec_id", "cluster", distance.alias("distance"))
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    return found.select(
        "vec_id", "cluster", "distance", of_cluster([inertia.get(c, 0) for c in range(k)]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256")
    )
