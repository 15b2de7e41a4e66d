"""Joins, deduplication and ordered-group operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("k_ = 1").drop("k_")


def top_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their place (column place)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def left_enrich(df: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join on key, with one row a key on the right, the first in the given order."""
    return df.join(first_of(right, [key], order), key, "left")


def anti_append(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], order: list[Column]) -> DataFrame:
    """old and those rows of new whose key and content old has not, and no earlier row of new either."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").join(old.select(*content).distinct(), content, "left_anti")
    fresh = first_of(first_of(fresh, keys, order), content, order)
    return old.unionByName(fresh.select(*old.columns))


def dense_series(df: DataFrame, year: str, measures: dict[str, Column]) -> DataFrame:
    """One row for each year from the first to the last, 0 where a year has none."""
    own = df.groupBy(year).agg(*(m.alias(k) for k, m in measures.items()))
    span = own.agg(F.min(year).alias("a"), F.max(year).alias("b")).select(F.explode(F.sequence("a", "b")).alias(year))
    return span.join(own, year, "left").na.fill(0, list(measures))


#: Rows that one task joins, groups and sorts.
TASK_ROWS = 500_000


def dealt(df: DataFrame, count: int, *keys: str) -> DataFrame:
    """df by hash of the keys in as many parts as count rows ask for, so that a task's memory does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS)), *keys)


def best_match(pairs: DataFrame, left: str, right: str, score: str, least: float = 0.26, margin: float = 0.04, sure: float = 0.45) -> DataFrame:
    """For each left row the best right row: its score must be least or more, and lead the second by margin or be sure or more. Confidence is the score, clipped to .55 and .78."""
    w = Window.partitionBy(left).orderBy(F.col(score).desc(), F.col(right))
    ranked = pairs.withColumns({"k_": F.row_number().over(w), "next_": F.lead(score).over(w)})
    lead = F.col(score) - F.coalesce("next_", F.lit(0.0))
    ok = (F.col("k_") == 1) & (F.col(score) >= least) & ((lead >= margin) | (F.col(score) >= sure))
    return ranked.where(ok).withColumn("confidence", F.least(F.greatest(F.col(score), F.lit(0.55)), F.lit(0.78))).drop("k_", "next_")


#: Query rows that meet a block of rows in one call.
QUERY_BLOCK = 20_000
#: Rows that a block of queries meets in one call.
ROW_BLOCK = 10_000
#: Pairs that are scored at once.
PAIRS = 1_000_000


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with 0, and their lengths; -1 where one is null or holds a null."""
    lists = column.combine_chunks()
    size = pc.list_value_length(lists).fill_null(-1).to_numpy().astype(np.int64)
    flat, own = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    out[own, np.arange(len(own)) - (np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0))[own]] = flat.cast(pa.float64()).fill_null(0.0).to_numpy()
    size[own[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, size


def nearest(rows: DataFrame, asked: DataFrame, key: str, vector: str, k: int, cosine: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """q_id, key, carry, score: rows that hold the k best of each query by cosine (largest) or Euclidean distance (least), ties by key.

    Every query is held against every other row: both are dealt by hash to blocks, and a block of the one meets each of the other in one call. The sums run
    component by component in doubles, as a fold over the pair would. A call hands on each query's k best rows, and those within 2e-9 of the last of
    them, of equal ones the first k. The score is null, and comes last, where a vector is null, holds a null, is of another length, or has no cosine.
    """
    n, m = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (rows, ROW_BLOCK)))
    dealt = lambda df, own, by, count: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(count)).cast("int"))
    copied = lambda df, other, count: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    left = copied(dealt(rows.where(F.col(key).isNotNull()).select(key, F.col(vector).alias("v_"), *carry), "r_block_", key, m), "q_block_", n)
    right = copied(dealt(asked.where(F.col(key).isNotNull()).select(F.col(key).alias("q_id"), F.col(vector).alias("v_")), "q_block_", "q_id", n), "r_block_", m)
    names = [key, *carry]
    kind = dict(rows.dtypes)

    def meet(held: pa.Table, queries: pa.Table) -> pa.Table:
        if not held.num_rows or not queries.num_rows:
            return pa.table({"q_id": queries.column("q_id").slice(0, 0), **{c: held.column(c).slice(0, 0) for c in names}, "score": pa.array([], pa.float64())})
        (v, v_size), (q, q_size) = _matrix(held.column("v_")), _matrix(queries.column("v_"))
        ids = pa.chunked_array([*held.column(key).chunks, *queries.column("q_id").chunks]).combine_chunks().dictionary_encode()
        code = ids.indices.to_numpy()
        rank = np.empty(len(ids.dictionary), dtype=np.int64)
        rank[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(len(rank))
        own, other = rank[code[: held.num_rows]], rank[code[held.num_rows :]]
        width = min(v.shape[1], q.shape[1])
        v, q = np.ascontiguousarray(v[:, :width].T), q[:, :width]
        at_q, at_v, scores = [], [], []
        step = max(1, PAIRS // held.num_rows)
        with np.errstate(all="ignore"):
            v_norm = np.sqrt(sum((x * x for x in v), np.zeros(held.num_rows)))
            for start in range(0, len(q), step):
                part = q[start : start + step]
                s = np.zeros((len(part), held.num_rows))
                for j in range(width):
                    x = part[:, j, None] * v[None, j] if cosine else v[None, j] - part[:, j, None]
                    s += x if cosine else x * x
                s = s / (np.sqrt(sum((x * x for x in part.T), np.zeros(len(part))))[:, None] * v_norm[None]) if cosine else np.sqrt(s)
                s[(v_size[None] < 0) | (v_size[None] != q_size[start : start + step, None])] = np.nan
                same = own[None] == other[start : start + step, None]
                low = np.where(np.isnan(s) | same, np.inf, -s if cosine else s)
                last = np.partition(low, k - 1, axis=1)[:, k - 1, None] if held.num_rows > k else np.full((len(part), 1), np.inf)
                a, b = np.nonzero((low <= last + 2e-9) & ~same)
                order = np.lexsort((own[b], low[a, b], a))
                a, b = a[order], b[order]
                opens = np.ones(len(a), dtype=bool)
                opens[1:] = (a[1:] != a[:-1]) | (low[a, b][1:] != low[a, b][:-1])
                every = np.arange(len(a))
                few = every - np.maximum.accumulate(np.where(opens, every, 0)) < k
                at_q.append(a[few] + start)
                at_v.append(b[few])
                scores.append(s[a[few], b[few]])
        score = np.concatenate(scores)
        got = held.select(names).take(pa.array(np.concatenate(at_v)))
        return pa.table({"q_id": queries.column("q_id").take(pa.array(np.concatenate(at_q))), **{c: got.column(c) for c in names}, "score": pa.array(score, mask=np.isnan(score))})

    kinds = f"q_id {kind[key]}, " + ", ".join(f"`{c}` {kind[c]}" for c in names) + ", score double"
    return left.groupBy("q_block_", "r_block_").cogroup(right.groupBy("q_block_", "r_block_")).applyInArrow(meet, kinds)


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q_id, key, cosine, place: the k nearest vectors of each query by cosine, ties by key. Each query is held against all vectors, in blocks."""
    scored = nearest(vectors, queries, key, vector, k, cosine=True).select("q_id", key, F.col("score").alias("cosine"))
    return top_of(scored, ["q_id"], [F.col("cosine").desc_nulls_last(), F.col(key)], k)
