"""Permutation importance, and selection of diverse uncertain rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.operators.folds import mixed
from mortise.operators.ranks import numbered
from mortise.session import materialise

#: Values that meet their rows in one call, and that a task sorts at a time.
RANGE_ROWS, PACK_VALUES = 2_000_000, 4_000_000


def _first_bits(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(high.shape, np.int64)


def _shrunk(x: np.ndarray) -> bytes:
    """The numbers compressed, first bytes of all first: those of sorted numbers are much alike."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _restored(x: bytes, kind: str, count: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(x, count * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, count).T).view(kind).ravel()


def permutation_importance(df: DataFrame, key: str, features: list[str], target: str, predict: Callable[[DataFrame], DataFrame], repeats: int = 10, seed: int = 0, count: int = 20) -> DataFrame:
    """feature, base_mae, mae, importance, spread, place: by how much the mean absolute error grows if a feature's values are dealt anew among the rows.

    predict adds a column `prediction` to a frame with the features. All features and repeats are one job: in repeat r, the row at place i in
    order of the key takes the feature's value from the row at place i in an order by a hash of (seed, r, feature, key). Both places are exact
    and depend on nothing but keys (which must be unique), so partitions don't matter. importance
    is the mean over repeats of error less base error, to six digits, spread its population deviation; the `count` most important features are given.

    Hashes are dealt to equal ranges of about RANGE_ROWS values, so values are shuffled once, and a range of rows meets the ranges of all shuffles that
    hold its places. Where a range begins in each shuffle is known from counts. A task sorts PACK_VALUES values at a time and sends to each range a
    compressed pack of them, with 64 bits of a hash beyond those that its range stands for.
    """
    names = [*features, target]
    base = numbered(df.select(key, *(F.col(f).cast("double").alias(f) for f in features), target), [F.col(key)])
    tries = len(features) * repeats
    n = base.count()
    bits = max(0, math.ceil(math.log2(max(1, n * tries / RANGE_ROWS))))
    each = df.select(F.col(key).alias("k_"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)))).alias("x")).select("k_", "x.*")
    hashes = F.concat(*(F.unhex(mixed(seed, F.lit(r), F.col("feature"), F.col("k_"))) for r in range(repeats)))
    hashed = each.select("i", hashes.alias("h"), "value")
    size = max(1, n >> bits)
    most = PACK_VALUES

    def digits(batch: pa.RecordBatch) -> np.ndarray:
        """The hashes of a batch: row, repeat, first and last 64 bits."""
        column = batch.column("h").cast(pa.binary(16 * repeats))
        return np.frombuffer(column.buffers()[1], ">u8").reshape(-1, repeats, 2)[column.offset : column.offset + len(column)].astype(np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros((tries, 1 << bits), dtype=np.int64)
        for batch in batches:
            own, i = _first_bits(digits(batch)[:, :, 0], bits), batch.column("i").to_numpy()
            for f in range(len(features)):
                for r in range(repeats):
                    many[f * repeats + r] += np.bincount(own[i == f, r], minlength=1 << bits)
        t, k = np.nonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t, pa.int32()), pa.array(many[t, k])], names=["range", "try", "many"])

    many = hashed.select("i", "h").mapInArrow(counted, "range long, try int, many long").groupBy("range", "try").agg(F.sum("many").alias("many"))
    start = F.sum("many").over(Window.partitionBy("try").orderBy("range")) - F.col("many")
    starts = materialise(many.withColumn("start", start), "starts")  # a row for each range and shuffle

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows * repeats >= most:
                yield packs(held)
                held, rows = [], 0
        if rows:
            yield packs(held)

    def packs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        hashes, i = np.concatenate([digits(b) for b in batches]), np.concatenate([b.column("i").to_numpy() for b in batches])
        column = pa.chunked_array([b.column("value") for b in batches]).combine_chunks()
        values, gaps = column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        sorted_, ends = [], []
        for f in range(len(features)):
            of = np.flatnonzero(i == f)
            for r in range(repeats):
                high, low = hashes[of, r, 0], hashes[of, r, 1]
                order = np.argsort(high)
                high, low, at = high[order], low[order], of[order]
                rest = (high << np.uint64(bits)) | (low >> np.uint64(64 - bits)) if bits else high
                sorted_.append((rest, values[at], gaps[at]))
                ends.append(np.append(0, np.cumsum(np.bincount(_first_bits(high, bits), minlength=1 << bits))))
        ends = np.array(ends)
        counts = np.diff(ends)
        some = np.flatnonzero(counts.sum(0))
        parts = [[np.concatenate([x[c][e[k] : e[k + 1]] for x, e in zip(sorted_, ends)]) for c in range(3)] for k in some]
        columns = [pa.array([_shrunk(part[c]) for part in parts], pa.binary()) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(counts[:, some].T), pa.list_(pa.int64())), *columns], names=["range", "counts", "rest", "values", "gaps"])

    dealt = hashed.mapInArrow(packed, "range long, counts array<long>, rest binary, values binary, gaps binary")
    begins = F.map_from_entries(F.collect_list(F.struct("try", "start")))
    heads = starts.groupBy("range").agg(begins.alias("b"))  # an entry for each shuffle
    none = F.lit(None).cast("binary")
    heads = heads.select("range", F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.coalesce(F.element_at("b", t), F.lit(-1))).alias("counts"), none.alias("rest"), none.alias("values"), none.alias("gaps"))
    spans = starts.groupBy("range").agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("many")).alias("to"))
    cells = spans.select("range", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / size), F.floor((F.col("to") - 1) / size))).alias("cell"))
    held = base.withColumn("cell", F.floor(F.col("place") / size)).join(cells, "cell").where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("to"))).select("range", "place", *names)
    kinds = "try int, " + ", ".join(f"`{c}` {t}" for c, t in held.select(*names).dtypes)

    def meet(packs: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows.column("place").to_numpy()))).combine_chunks()  # without gaps
        first = rows.column("place")[0].as_py()
        pieces: list[list[list[np.ndarray]]] = [[] for _ in range(tries)]
        for own, *shrunk in zip(*(packs.column(c).to_pylist() for c in ("counts", "rest", "values", "gaps"))):
            if shrunk[0] is None:
                begin = own
                continue
            ends = np.cumsum(own)
            columns = [_restored(x, kind, int(ends[-1])) for x, kind in zip(shrunk, ("<u8", "<f8", "?"))]
            for t in np.flatnonzero(own):
                pieces[t].append([c[ends[t] - own[t] : ends[t]] for c in columns])
        out = []
        for t, mine in enumerate(pieces):
            if mine:
                rest, values, gaps = (np.concatenate([x[c] for x in mine]) for c in range(3))
                order = np.argsort(rest)
                if (rest[order[1:]] == rest[order[:-1]]).any():  # hashes that are alike this far keep to the order of their values
                    order = np.lexsort((gaps, values, rest))
                changed = rows.slice(begin[t] - first, len(order)).select(names)
                changed = changed.set_column(t // repeats, features[t // repeats], pa.array(values[order], mask=gaps[order]))
                out.append(changed.add_column(0, "try", pa.array(np.full(len(order), t, np.int32))))
        return pa.concat_tables(out)

    met = dealt.unionByName(heads).groupBy("range").cogroup(held.groupBy("range")).applyInArrow(meet, kinds)
    changed = met.withColumns({"feature": F.element_at(F.array(*map(F.lit, features)), (F.floor(F.col("try") / repeats) + 1).cast("int")), "repeat": F.col("try") % repeats})
    error = F.avg(F.abs(F.col("prediction") - F.col(target)))
    plain = predict(df.select(*names)).agg(error.alias("base_mae"))
    one = predict(changed).groupBy("feature", "repeat").agg(error.alias("mae"))
    out = one.groupBy("feature").agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("spread")).crossJoin(F.broadcast(plain))  # one row
    out = out.select("feature", "base_mae", "mae", (F.round(F.col("mae") - F.col("base_mae"), 6) + 0.0).alias("importance"), "spread")
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))  # a row for each feature
    return out.withColumn("place", place).where(F.col("place") <= count)


def diverse_uncertain(df: DataFrame, group: str, key: str, base: str, disagreement: str, k: int) -> DataFrame:
    """group, key, how: for each group k rows (all but one, if it has fewer) that cover the range of base and disagree much.

    The group's rows are ordered by base, then by falling disagreement (nulls last, ties by key). Of k equally spaced places each takes, of
    its row and the two beside it, the one with most disagreement that no place before took (how = 'spaced'); what is missing is
    filled up by disagreement ('filled'). Only three rows for each place meet in one fold; k is a parameter.
    """
    low = -F.coalesce(F.when(~F.isnan(disagreement), F.col(disagreement)), F.lit(float("-inf")))
    x = F.col(base).cast("double")
    rows = df.select(group, key, F.when(~F.isnan(x), x).alias("base"), low.alias("low"))
    placed = numbered(rows, [F.asc_nulls_last("base"), F.col("low"), F.col(key)], [group])
    many = df.groupBy(F.col(group).alias("g_")).agg((F.count(F.lit(1)) - 1).alias("last")).withColumn("kk", F.least(F.lit(k).cast("long"), "last")).where("kk > 0")
    step = F.col("last") / F.when(F.col("kk") > 1, F.col("kk") - 1)
    spots = many.select("g_", "kk", F.explode(F.sequence(F.lit(0), F.col("kk") - 1)).alias("j"), "last", step.alias("step"))
    spots = spots.select("g_", "kk", "j", F.when(F.col("j") == 0, 0).otherwise(F.rint(F.col("j") * F.col("step"))).cast("long").alias("spot"))
    near = spots.select("g_", "kk", "j", F.explode(F.sequence(F.col("spot") - 1, F.col("spot") + 1)).alias("at"))
    met = near.join(placed, F.col("g_").eqNullSafe(F.col(group)) & (F.col("at") == F.col("place"))).groupBy("g_", "kk", "j").agg(F.array_sort(F.collect_list(F.struct("low", "place", F.col(key).alias("key")))).alias("window"))
    windows = met.groupBy("g_", "kk").agg(F.array_sort(F.collect_list(F.struct("j", "window"))).alias("w"))
    none = F.array().cast(f"array<{dict(df.dtypes)[key]}>")

    def take(taken: Column, w: Column) -> Column:
        free = F.filter(w["window"], lambda x: ~F.array_contains(taken, x["key"]))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.get(free, F.lit(0))["key"]))).otherwise(taken)

    taken = windows.select("g_", "kk", F.aggregate("w", none, take).alias("taken"))
    spaced = taken.select(F.col("g_").alias(group), F.explode("taken").alias(key), F.lit("spaced").alias("how"))
    open_ = taken.select("g_", "taken", (F.col("kk") - F.size("taken")).alias("open")).where("open > 0")
    rest = placed.join(open_, F.col("g_").eqNullSafe(F.col(group))).where(~F.array_contains("taken", F.col(key)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("low", "place"))
    filled = rest.withColumn("n_", place).where(F.col("n_") <= k).where(F.col("n_") <= F.col("open")).select(group, key, F.lit("filled").alias("how"))  # the first limit is met before the shuffle
    return spaced.unionByName(filled)
