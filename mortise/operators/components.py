"""Principal components from a matrix of products that tasks sum up, and regressors chosen by folds of groups.

Rows that are alike in all features are a class. What fits squared errors needs a class's number of rows and mean target only, so trees and kernels are
fitted on weighted classes, and predictions are made once a class; the errors are those of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.base import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

#: Models that are fitted at a time.
FITS = 4
#: Classes in a part, classes whose predictions are broadcast, and rows that are drawn again at a time.
CLASS_ROWS, CLASSES_SENT, DRAWN_ROWS = 50_000, 500_000, 500_000
#: Rows from which on a forest's trees are fitted on classes, one by one: the passes over fewer rows take less than the jobs for each tree.
FOREST_ROWS = 2_000_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def products(df: DataFrame, vector: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of vectors with exactly `width` finite components, their sum, and the sum of their outer products.

    Each task adds up its own and hands on width + 1 rows, which are summed by place before (width + 1)^2 numbers at most come to the driver; width is
    the number of columns.
    """
    shift = width + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shift, shift))
        for b in batches:
            if b.num_rows:
                x = np.column_stack((np.ones(b.num_rows), _matrix(b.column(0), width)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(shift), shift)), pa.array(np.tile(np.arange(shift), shift)), pa.array(total.reshape(-1))], names=["i", "j", "x"])

    sums = usable(df, vector, width).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(part, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((shift, shift))
    for r in sums:
        total[r["i"], r["j"]] = r["x"]
    return int(round(total[0, 0])), total[0, 1:], total[1:, 1:]


def usable(df: DataFrame, vector: str, width: int) -> DataFrame:
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.coalesce((F.size(vector) == width) & finite, F.lit(False)))


class Components:
    """mean (d), axes (n x d) and shares of variance (n) of a fit."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, shares: np.ndarray) -> None:
        self.mean, self.axes, self.shares = mean, axes, shares


def fit_components(train: DataFrame, vector: str, width: int, count: int) -> Components:
    """min(count, rows - 1, width) principal axes of the training vectors alone, by falling variance; the largest entry of an axis is positive."""
    n, total, outer = products(train, vector, width)
    if n < 2:
        return Components(total / max(n, 1), np.zeros((0, width)), np.zeros(0))
    mean = total / n
    values, axes = np.linalg.eigh((outer - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(-values, kind="stable")[: min(count, n - 1, width)]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Components(mean, axes, np.maximum(values[order], 0) / max(values.clip(0).sum(), 1e-300))


def project(df: DataFrame, vector: str, fit: Components, prefix: str = "pc") -> DataFrame:
    """df with a column for each axis: the centred vector's product with it; null where the vector is not of the fit's width and finite."""
    width = len(fit.mean)
    spark_fit = df.sparkSession.sparkContext.broadcast((fit.mean, fit.axes))  # width x axes numbers
    names = [f"{prefix}{k}" for k in range(len(fit.axes))]
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + "".join(f", {n} double" for n in names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = spark_fit.value
        for b in batches:
            lists = b.column(vector)
            good = np.array([v.is_valid and len(v) == width and all(e is not None and np.isfinite(e) for e in v.as_py()) for v in lists], dtype=bool)
            out = np.full((b.num_rows, len(axes)), np.nan)
            if good.any():
                out[good] = (_matrix(lists.filter(pa.array(good)), width) - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[:, k], mask=~good) for k in range(len(axes)))], names=[*b.schema.names, *names])

    return df.mapInArrow(of, kinds)


def classes(df: DataFrame, features: list[str], sums: dict[str, Column]) -> DataFrame:
    """features and sums (a row for each class), kept in few parts if there are few; the caller gives it back by unpersist()."""
    found = df.groupBy(*features).agg(*(x.alias(n) for n, x in sums.items())).persist()
    parts = max(1, ceil(found.count() / CLASS_ROWS))
    few = found.coalesce(parts).persist()
    few.count()
    found.unpersist()
    return few


class Kernel:
    """Ridge regression on similarities exp(-gamma |x - l|^2) to landmarks (Nystroem's method).

    Landmarks are at most `landmarks` training rows in order of a hash of their features: a documented, bounded sample of the kernel's columns. The fit
    itself reads all rows, through the landmarks' matrix of products.
    """

    def __init__(self, gamma: float | None = None, ridge: float = 1e-3, landmarks: int = 100) -> None:
        self.gamma, self.ridge, self.landmarks = gamma, ridge, landmarks

    def fit(self, df: DataFrame, features: list[str], target: str) -> Callable[[DataFrame], DataFrame]:
        alike = classes(df, features, {"n_": F.count(F.lit(1)), "y_": F.sum(target)})
        rows = alike.select(F.array(*features).alias("x")).orderBy(F.xxhash64("x"), "x").limit(self.landmarks).collect()
        marks = np.array([r["x"] for r in rows], dtype=float)
        stats = df.agg(*(F.avg(c) for c in features), *(F.stddev_samp(c) for c in features)).first()
        d = len(features)
        mean, scale = np.array(stats[:d], dtype=float), np.array([s if s else 1.0 for s in stats[d:]], dtype=float)
        gamma = self.gamma or 1.0 / d
        marks = (marks - mean) / scale

        def similar(batch: pa.RecordBatch) -> np.ndarray:
            x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features]) - mean) / scale
            return np.exp(-gamma * ((x[:, None, :] - marks[None]) ** 2).sum(2))

        m = len(marks) + 1

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, m + 1))
            for b in batches:
                for at in range(0, b.num_rows, 1_000):
                    piece = b.slice(at, 1_000)
                    k = np.column_stack((np.ones(piece.num_rows), similar(piece)))
                    n, y = (piece.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_", "y_"))
                    total += k.T @ np.column_stack((k * n[:, None], y))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(m), m + 1)), pa.array(np.tile(np.arange(m + 1), m)), pa.array(total.reshape(-1))], names=["i", "j", "x"])

        total = np.zeros((m, m + 1))
        for r in alike.mapInArrow(part, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # (landmarks + 1)^2 numbers
            total[r["i"], r["j"]] = r["x"]
        alike.unpersist()
        inner = np.exp(-gamma * ((marks[:, None, :] - marks[None]) ** 2).sum(2))
        penalty = np.zeros((m, m))
        penalty[1:, 1:] = inner + 1e-9 * np.eye(m - 1)
        weights = np.linalg.lstsq(total[:, :m] + self.ridge * total[0, 0] * penalty / m, total[:, m], rcond=1e-12)[0]

        def predict(other: DataFrame) -> DataFrame:
            kinds = ", ".join(f"`{c}` {t}" for c, t in other.dtypes) + ", prediction double"

            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for at in range(0, b.num_rows, 1_000):
                        piece = b.slice(at, 1_000)
                        yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(weights[0] + similar(piece) @ weights[1:])], names=[*piece.schema.names, "prediction"])

            return other.mapInArrow(of, kinds)

        return predict


class Estimated:
    """One of Spark's own regressors over assembled features."""

    def __init__(self, estimator) -> None:  # noqa: ANN001
        self.estimator = estimator

    def fit(self, df: DataFrame, features: list[str], target: str) -> Callable[[DataFrame], DataFrame]:
        assembler = VectorAssembler(inputCols=features, outputCol="features_")
        model: Model = self.estimator.copy().setParams(featuresCol="features_", labelCol=target, predictionCol="prediction").fit(assembler.transform(df))
        return lambda other: model.transform(assembler.transform(other)).drop("features_")


class Boosted:
    """Spark's boosted trees for squared errors, which all take all rows, on weighted classes."""

    def __init__(self, depth: int, rounds: int, seed: int) -> None:
        self.estimator = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed, weightCol="n_")

    def fit(self, df: DataFrame, features: list[str], target: str) -> Callable[[DataFrame], DataFrame]:
        alike = classes(df, features, {"n_": F.count(F.lit(1)).cast("double"), target: F.avg(target)})
        predict = Estimated(self.estimator).fit(alike, features, target)
        alike.unpersist()
        return predict


class Forest:
    """Spark's regression trees, each on rows drawn anew (every row Poisson(1) times), a third of the features at a node.

    Up to FOREST_ROWS rows this is Spark's forest. Of more, all rows are drawn for all trees in one pass, which sums up classes; a tree is fitted on its
    weighted classes. Either way each tree draws from all rows.
    """

    def __init__(self, depth: int, trees: int, seed: int) -> None:
        self.depth, self.trees, self.seed = depth, trees, seed

    def fit(self, df: DataFrame, features: list[str], target: str) -> Callable[[DataFrame], DataFrame]:
        if df.count() <= FOREST_ROWS:
            return Estimated(RandomForestRegressor(maxDepth=self.depth, numTrees=self.trees, seed=self.seed)).fit(df, features, target)
        seed, sums = self.seed, [f"{c}{t}_" for c in "wy" for t in range(self.trees)]

        def summed(batches: list[pa.RecordBatch], r: np.random.Generator) -> pa.RecordBatch:
            rows = pa.Table.from_batches(batches).combine_chunks()
            w = r.poisson(1.0, (len(sums) // 2, rows.num_rows)).astype(float)
            y = rows.column(target).to_numpy()
            drawn = pa.table([*(rows.column(c) for c in features), *map(pa.array, w), *map(pa.array, w * y)], names=[*features, *sums])
            got = drawn.group_by(features, use_threads=False).aggregate([(c, "sum") for c in sums]).select([*features, *(f"{c}_sum" for c in sums)])
            return got.rename_columns([*features, *sums]).combine_chunks().to_batches()[0]

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r, held, rows = np.random.default_rng([seed, TaskContext.get().partitionId()]), [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    rows += b.num_rows
                if rows >= DRAWN_ROWS:
                    yield summed(held, r)
                    held, rows = [], 0
            if rows:
                yield summed(held, r)

        each = df.select(*(F.col(c).cast("double").alias(c) for c in [*features, target])).mapInArrow(drawn, ", ".join(f"`{c}` double" for c in [*features, *sums]))
        alike = classes(each, features, {c: F.sum(c) for c in sums})
        assembler = VectorAssembler(inputCols=features, outputCol="features_")

        def grown(t: int) -> Model:
            own = alike.where(F.col(f"w{t}_") > 0).select(*features, F.col(f"w{t}_").alias("n_"), (F.col(f"y{t}_") / F.col(f"w{t}_")).alias("mean_"))
            tree = RandomForestRegressor(maxDepth=self.depth, numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", seed=seed + t, weightCol="n_", featuresCol="features_", labelCol="mean_", predictionCol=f"p{t}_")
            return tree.fit(assembler.transform(own))

        with ThreadPool(FITS) as pool:
            models = pool.map(inheritable_thread_target(df.sparkSession)(grown), range(self.trees), 1)
        alike.unpersist()

        def predict(other: DataFrame) -> DataFrame:
            out = assembler.transform(other)
            for m in models:
                out = m.transform(out)
            trees = [f"p{t}_" for t in range(len(models))]
            return out.withColumn("prediction", sum((F.col(c) for c in trees), F.lit(0.0)) / len(trees)).drop("features_", *trees)

        return predict


def grid(seed: int = 0) -> dict[str, Estimated | Boosted | Forest | Kernel]:
    """The regressors that are tried, by name."""
    out: dict[str, Estimated | Boosted | Forest | Kernel] = {f"forest_{depth}": Forest(depth, 30, seed) for depth in (4, 8)}
    out |= {"boosted": Boosted(3, 30, seed)}
    out |= {f"elastic_{a}": Estimated(LinearRegression(regParam=a, elasticNetParam=0.5)) for a in (0.001, 0.1)}
    out |= {"huber": Estimated(LinearRegression(loss="huber", regParam=0.001))}
    return out | {f"kernel_{g}": Kernel(gamma=g) for g in (0.1, 1.0)}


def cross_validated(df: DataFrame, features: list[str], target: str, fold: str, models: dict[str, Estimated | Boosted | Forest | Kernel]) -> DataFrame:
    """model, fold, n, r2, mae for each model and fold, fitted on the other folds; rows with a null feature or target take no part.

    The rows are dealt to as many parts as there are cores: what is stored of a join may else be a single part, and each of hundreds of passes one task.
    FITS models are fitted at a time, as Spark's own cross-validation does.
    r2 is 1 - squared error / squared deviation from the held-out mean, null where that is 0.
    """
    spark = df.sparkSession
    known = df.select(*(F.col(c).cast("double").alias(c) for c in [*features, target]), fold).dropna(subset=[*features, target]).repartition(spark.sparkContext.defaultParallelism).persist()
    numbers = [r[0] for r in known.select(fold).distinct().orderBy(fold).collect()]  # folds, a parameter

    own = {k: known.where(F.col(fold) == k).select(*features).distinct().persist() for k in numbers}
    sent = {k: own[k].count() <= CLASSES_SENT for k in numbers}

    def fitted(case: tuple[str, object]) -> DataFrame:
        name, k = case
        predict = models[name].fit(known.where(F.col(fold) != k), features, target)
        each = predict(own[k]).select(*features, "prediction")
        each = known.where(F.col(fold) == k).join(F.broadcast(each) if sent[k] else each, features)
        e = F.col("prediction") - F.col(target)
        got = each.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(target) * F.count(target), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"))
        return got.select(F.lit(name).alias("model"), F.lit(k).alias("fold"), "n", "r2", "mae")

    with ThreadPool(FITS) as pool:
        scores = pool.map(inheritable_thread_target(spark)(fitted), [(name, k) for name in models for k in numbers], 1)
    return reduce(DataFrame.unionByName, scores) if scores else None


def chosen(scores: DataFrame) -> str | None:
    """The model with the highest mean r2 over the folds; ties: the first by name."""
    best = scores.groupBy("model").agg(F.avg("r2").alias("r2")).orderBy(F.desc_nulls_last("r2"), "model").first()  # a row for each model
    return best["model"] if best else None
