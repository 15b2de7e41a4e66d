"""Folds, importance, selection and models, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import arima as ar, components as cp, folds as fo, importance as im
from mortise.plans.statistics import rounded
from mortise.session import materialise, table


def stratified_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders in five folds with balanced priorities."""
    return fo.stratified_group_folds(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 5, seed=7)


def repeated_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return fo.repeated_group_folds(table(spark, sf, "orders"), "o_custkey", 5, 3, seed=7)


def leave_one_group_out_folds(spark: SparkSession, sf: str) -> DataFrame:
    return fo.leave_one_group_out(table(spark, sf, "part"), "p_brand")


def train_validation_test(spark: SparkSession, sf: str) -> DataFrame:
    return fo.train_validation_test(table(spark, sf, "orders"), "o_custkey", seed=7)


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns the discounted price leans on, as a prediction of the charge with tax."""
    number = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    cents = [F.round(F.col(c) * 100).cast("long").cast("string") for c in number.values()]  # lines may share all keys; those equal in this too are alike
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cents)
    lines = table(spark, sf, "lineitem").select(line.alias("line"), *(F.col(c).cast("double").alias(n) for n, c in number.items())).withColumn("charge", F.col("price") * (1 - F.col("discount")) * (1 + F.col("tax")))
    discounted = F.col("price") * (1 - F.col("discount"))
    return rounded(im.permutation_importance(lines, "line", list(number), "charge", lambda df: df.withColumn("prediction", discounted), repeats=10, seed=7), 3)


def diverse_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
    return im.diverse_uncertain(parts, "p_brand", "p_partkey", "price", "size", 12)


def component_features(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings on eight principal axes, which are fitted on four fifths of the vectors; no twin, SQL has no eigenvectors."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    fit = cp.fit_components(v.where("vec_id % 5 > 0"), "embedding", 64, 8)
    return rounded(cp.project(v, "embedding", fit).drop("embedding"), 5)


def regressor_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Eight regressors of an order's price by three folds of whole customers, and which is chosen; no twin, the models are fitted."""
    o = table(spark, sf, "orders")
    f = fo.stratified_group_folds(o, "o_custkey", "o_orderstatus", 3, seed=7).select("o_custkey", "fold")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("gross"), F.sum("l_quantity").alias("pieces"), F.count(F.lit(1)).alias("lines"))
    known = o.join(f, "o_custkey").join(lines, "o_orderkey").select("fold", "pieces", "lines", F.year("o_orderdate").alias("year"), "gross")
    scores = cp.cross_validated(known, ["pieces", "lines", "year"], "gross", "fold", cp.grid(7))
    scores = materialise(scores, "scores")
    return rounded(scores.withColumn("chosen", F.col("model") == cp.chosen(scores)), 4)


def arima_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order values of each priority, continued by the moving-average model with the lowest AIC; no twin, the models are fitted."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return rounded(ar.arima_grid(o, "o_orderpriority", "month", "total", ahead=20), 2)


QUERIES = {f.__name__: f for f in (component_features, regressor_grid, arima_grid, stratified_group_folds, repeated_group_folds, leave_one_group_out_folds, train_validation_test, permutation_importance, diverse_uncertainty)}

ORACLES = {
    "stratified_group_folds": """
WITH c AS (SELECT o_custkey AS g, o_orderpriority AS l, count(*) AS c FROM orders GROUP BY 1, 2),
s AS (SELECT g, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY 1),
t AS (SELECT g, n, string_agg(coalesce(l, '') || '=' || CAST(CAST(floor(8 * c / n + 0.5) AS INTEGER) AS VARCHAR), ';' ORDER BY coalesce(l, '') || '=' || CAST(CAST(floor(8 * c / n + 0.5) AS INTEGER) AS VARCHAR)) AS stratum FROM c JOIN s USING (g) GROUP BY 1, 2),
p AS (SELECT *, (row_number() OVER (ORDER BY stratum, n DESC, md5('7:' || CAST(g AS VARCHAR)), g) - 1) % 10 AS k FROM t)
SELECT g AS o_custkey, n, stratum, CAST(least(k, 9 - k) AS INTEGER) AS fold FROM p
""",
    "repeated_group_folds": "SELECT CAST(r AS INTEGER) AS repeat, g AS o_custkey, CAST((row_number() OVER (PARTITION BY r ORDER BY md5('7:' || CAST(r AS VARCHAR) || ':' || CAST(g AS VARCHAR)), g) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT o_custkey AS g FROM orders), (SELECT unnest(range(3)) AS r)",
    "leave_one_group_out_folds": "SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS fold FROM (SELECT DISTINCT p_brand FROM part)",
    "train_validation_test": "WITH p AS (SELECT g, row_number() OVER (ORDER BY md5('7:' || CAST(g AS VARCHAR)), g) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS g FROM orders)) SELECT g AS o_custkey, CASE WHEN k < floor(0.8::DOUBLE * n + 0.5) THEN 'train' WHEN k < floor((0.8::DOUBLE + 0.1::DOUBLE) * n + 0.5) THEN 'validation' ELSE 'test' END AS part FROM p",
    "permutation_importance": """
WITH b0 AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT)) AS line, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem),
b AS (SELECT *, price * (1 - discount) * (1 + tax) AS charge FROM b0),
p AS (SELECT *, row_number() OVER (ORDER BY line) AS k FROM b),
e AS (SELECT r, f, line, CASE f WHEN 'price' THEN price WHEN 'discount' THEN discount ELSE 0 END AS v FROM b, (SELECT unnest(range(10)) AS r), (SELECT unnest(['price', 'quantity', 'discount', 'tax']) AS f)),
d AS (SELECT r, f, v, row_number() OVER (PARTITION BY r, f ORDER BY md5('7:' || CAST(r AS VARCHAR) || ':' || f || ':' || line), line) AS k FROM e),
m AS (SELECT f, r, avg(abs(CASE f WHEN 'price' THEN v ELSE price END * (1 - CASE f WHEN 'discount' THEN v ELSE discount END) - charge)) AS mae FROM p JOIN d USING (k) GROUP BY 1, 2),
z AS (SELECT avg(abs(price * (1 - discount) - charge)) AS base FROM b),
o AS (SELECT f AS feature, base AS base_mae, avg(mae) AS mae, round(avg(mae) - base, 6) + 0.0 AS importance, stddev_pop(mae) AS spread FROM m, z GROUP BY f, base)
SELECT feature, round(base_mae, 3) AS base_mae, round(mae, 3) AS mae, round(importance, 3) AS importance, round(spread, 3) AS spread, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS place FROM o
""",
    "diverse_uncertainty": """
WITH r AS (SELECT p_brand, p_partkey, -CAST(p_size AS DOUBLE) AS low, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_retailprice AS DOUBLE), -CAST(p_size AS DOUBLE), p_partkey) - 1 AS place FROM part),
m AS (SELECT p_brand, count(*) - 1 AS last, least(12, count(*) - 1) AS kk FROM r GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT p_brand, kk, j, CASE WHEN j = 0 THEN 0 ELSE CAST(round_even(j * (last / CAST(kk - 1 AS DOUBLE)), 0) AS BIGINT) END AS spot FROM (SELECT *, unnest(range(kk)) AS j FROM m)),
w AS (SELECT s.p_brand, kk, j, list(r.p_partkey ORDER BY low, place) AS w FROM s JOIN r ON r.p_brand = s.p_brand AND abs(r.place - spot) <= 1 GROUP BY 1, 2, 3),
t AS (SELECT p_brand, kk, list_reduce(list_prepend(CAST([] AS BIGINT[]), list(w ORDER BY j)), lambda a, x: list_concat(a, list_filter(x, lambda y: NOT list_contains(a, y))[1:1])) AS taken FROM w GROUP BY 1, 2),
f AS (SELECT r.p_brand, p_partkey, kk - len(taken) AS open, row_number() OVER (PARTITION BY r.p_brand ORDER BY low, place) AS n FROM r JOIN t ON t.p_brand = r.p_brand WHERE NOT list_contains(taken, p_partkey))
SELECT p_brand, unnest(taken) AS p_partkey, 'spaced' AS how FROM t UNION ALL SELECT p_brand, p_partkey, 'filled' FROM f WHERE n <= open
""",
}
