"""Nearest neighbours, retrieval from two sides, and model pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from mortise.operators.relations import nearest, top_of


def knn_mean(queries: DataFrame, rows: DataFrame, key: str, vector: str, value: str, k: int = 5) -> DataFrame:
    """key, estimate, distance: for each query the inverse-distance weighted mean of value over its k nearest other rows (Euclidean, ties by key) and their mean distance.

    Queries are held against all rows, in blocks; of each query only the best rows of a block reach the last sort.
    """
    pairs = nearest(rows.where(F.col(value).isNotNull()), queries, key, vector, k, cosine=False, carry=(value,))
    near = top_of(pairs.select("q_id", key, F.col(value).alias("v_"), F.round("score", 9).alias("d_")), ["q_id"], [F.col("d_").asc_nulls_last(), F.col(key)], k)
    w = 1.0 / (F.col("d_") + 1e-6)
    return near.groupBy(F.col("q_id").alias(key)).agg((F.sum(w * F.col("v_")) / F.sum(w)).alias("estimate"), F.avg("d_").alias("distance"))


def hybrid(first: DataFrame, second: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """The k best keys of each query from two lists of (query, key, score): a key in both keeps its higher score; ties by key."""
    both = first.select(query, key, score).unionByName(second.select(query, key, score))
    return top_of(both.groupBy(query, key).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("lists")), [query], [F.col(score).desc_nulls_last(), F.col(key)], k)


def label_model(train: DataFrame, rows: DataFrame, numbers: list[str], categories: list[str], label: str) -> DataFrame:
    """rows with probability: medians for missing numbers, standard scale, one-hot categories (unseen ones kept apart), logistic regression."""
    prepare = lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categories} | {n: F.col(n).cast("double") for n in numbers})
    steps = [
        Imputer(strategy="median", inputCols=numbers, outputCols=[f"{n}_f" for n in numbers]), VectorAssembler(inputCols=[f"{n}_f" for n in numbers], outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="scaled_", withMean=True),
        StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_h" for c in categories]),
        VectorAssembler(inputCols=["scaled_", *(f"{c}_h" for c in categories)], outputCol="x_"), LogisticRegression(featuresCol="x_", labelCol=label, regParam=0.01, probabilityCol="p_"),
    ]
    model = Pipeline(stages=steps).fit(prepare(train.where(F.col(label).isNotNull())))
    return model.transform(prepare(rows)).withColumn("probability", F.get(vector_to_array("p_"), F.lit(1))).select(*rows.columns, "probability")


def zscores(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with z: value standardised inside its group (0 where it doesn't vary)."""
    w = Window.partitionBy(group)
    return df.withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))), F.lit(0.0)))
