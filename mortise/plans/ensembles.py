"""Ensemble and calibration queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mortise.operators import ensembles as en, statistics as st
from mortise.plans.statistics import _PRED, predictions, rounded
from mortise.operators.ranks import with_quantiles
from mortise.session import table


def ensemble_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(en.by_id(predictions(spark, sf).withColumn("w", (F.col("run") + 1).cast("double")), "id", "pred", "w"), 7)


def run_stability(spark: SparkSession, sf: str) -> DataFrame:
    j = predictions(spark, sf).withColumn("e", F.abs(F.col("pred") - F.col("target")))
    sums = j.groupBy("run").agg(F.count("e").alias("n"), F.avg("e").alias("mae"), F.max("e").alias("worst"), F.count_if(F.col("e") > 500).alias("over_500"))
    return rounded(with_quantiles(sums, j, ["run"], "e", {"p50": 0.5, "p90": 0.9}), 4)


def run_filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    runs = predictions(spark, sf).groupBy("run").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))
    return rounded(en.filter_runs(runs, F.col("mae") <= 1.0, 2), 4)


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = predictions(spark, sf).groupBy("p_brand", "run").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))
    return rounded(runs.groupBy("p_brand").agg(F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("std"), st.quantile("mae", 0.5).alias("median"), st.quantile("mae", 0.05).alias("q05"), st.quantile("mae", 0.95).alias("q95")), 4)


def paired_improvement(spark: SparkSession, sf: str) -> DataFrame:
    runs = predictions(spark, sf).where("run < 2").groupBy("p_brand").pivot("run", [0, 1]).agg(F.avg(F.abs(F.col("pred") - F.col("target"))))
    gain = runs.select((F.col("0") - F.col("1")).alias("gain"))
    return rounded(gain.agg(F.count("gain").alias("n"), F.avg("gain").alias("mean"), st.quantile("gain", 0.5).alias("median"), F.avg((F.col("gain") > 0).cast("double")).alias("win_rate"), F.count_if(F.col("gain") < 0).alias("worse")), 4)


def rank_quantile_map(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("score"), F.col("p_retailprice").alias("value"))
    return rounded(en.rank_quantile_map(p, "p_brand", "score", "value", "p_partkey"))


def recenter_group_median(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("pred"), F.col("p_retailprice").alias("anchor"))
    return rounded(en.recenter(p, "p_brand", "pred", "anchor"), 4)


def prior_fallback(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    train = p.where("p_partkey % 7 = 0")  # the labelled share, a property of the query, over the whole table
    return rounded(en.fallback_prior(train, p.select("p_partkey", "p_brand", "p_type"), ["p_type", "p_brand"], "p_retailprice"), 4)


def blend_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).groupBy("id").pivot("run", [0, 1, 2, 3]).agg(F.avg("pred"))
    return rounded(p.select("id", en.blend({"0": 0.5, "1": 0.3, "2": 0.2, "3": 0.1}).alias("blend")), 4)


def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    by = en.by_id(predictions(spark, sf), "id", "pred").select("id", "mean", "std", F.lit(0).alias("g"))
    n = by.agg(F.count(F.lit(1)).alias("n"))
    # ranks over all ids by a range-partitioned sort would need one task for a global window; counts by value are summed instead
    for c in ("mean", "std"):
        by = by.withColumn(c, F.round(c, 3))
        own = by.groupBy(c).agg(F.count(F.lit(1)).alias("k")).withColumn("r_" + c, F.sum("k").over(Window.orderBy(c)) - (F.col("k") - 1) / 2.0).drop("k")
        by = by.join(own, c)
    by = by.crossJoin(F.broadcast(n))
    return rounded(by.select("id", (0.6 * F.col("r_mean") / F.col("n") + 0.4 * F.col("r_std") / F.col("n")).alias("score")), 5)


def best_offset(spark: SparkSession, sf: str) -> DataFrame:
    j = predictions(spark, sf).select("p_brand", (F.col("target") - F.col("pred")).alias("r"))
    grid = F.explode(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: i * 50))
    maes = j.select("p_brand", "r", grid.alias("offset")).groupBy("p_brand", "offset").agg(F.round(F.avg(F.abs(F.col("r") - F.col("offset"))), 6).alias("mae"))
    w = Window.partitionBy("p_brand").orderBy("mae", "offset")
    return maes.withColumn("k", F.row_number().over(w)).where("k = 1").select("p_brand", "offset", F.round("mae", 4).alias("mae"))


QUERIES = {f.__name__: f for f in (ensemble_by_id, run_stability, run_filter_fallback, split_summary, paired_improvement, rank_quantile_map, recenter_group_median, prior_fallback, blend_columns, candidate_ranking, best_offset)}
_MAE = "avg(abs(pred - target))"
ORACLES = {
    "ensemble_by_id": f"""WITH j AS ({_PRED}), g AS (SELECT id, count(pred) AS n, avg(pred) AS mean, quantile_cont(pred, 0.5) AS median, coalesce(stddev_samp(pred), 0) AS std, max(pred) - min(pred) AS range, sum((run + 1) * pred) / nullif(sum(run + 1), 0) AS weighted, list_sort(list(pred)) AS a FROM j GROUP BY 1),
      k AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE CAST(floor(n * 0.1) AS INT) END AS k FROM g)
      SELECT id, n, round(mean, 7) AS mean, round(median, 7) AS median, round(std, 7) AS std, round(range, 7) AS range, round(weighted, 7) AS weighted, round(list_avg(a[k + 1 : n - k]), 7) AS trimmed FROM k""",
    "run_stability": f"WITH j AS ({_PRED}), e AS (SELECT run, abs(pred - target) AS e FROM j) SELECT run, count(e) AS n, round(avg(e), 4) AS mae, round(quantile_cont(e, 0.5), 4) AS p50, round(quantile_cont(e, 0.9), 4) AS p90, round(max(e), 4) AS worst, count(*) FILTER (WHERE e > 500) AS over_500 FROM e GROUP BY 1",
    "run_filter_fallback": f"WITH j AS ({_PRED}), r AS (SELECT run, {_MAE} AS mae FROM j GROUP BY 1) SELECT run, round(mae, 4) AS mae FROM r WHERE mae <= 1.0 OR (SELECT count(*) FROM r WHERE mae <= 1.0) < 2",
    "split_summary": f"WITH j AS ({_PRED}), r AS (SELECT p_brand, run, {_MAE} AS mae FROM j GROUP BY 1, 2) SELECT p_brand, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS std, round(quantile_cont(mae, 0.5), 4) AS median, round(quantile_cont(mae, 0.05), 4) AS q05, round(quantile_cont(mae, 0.95), 4) AS q95 FROM r GROUP BY 1",
    "paired_improvement": f"WITH j AS ({_PRED}), r AS (SELECT p_brand, avg(abs(pred - target)) FILTER (WHERE run = 0) - avg(abs(pred - target)) FILTER (WHERE run = 1) AS gain FROM j WHERE run < 2 GROUP BY 1) SELECT count(gain) AS n, round(avg(gain), 4) AS mean, round(quantile_cont(gain, 0.5), 4) AS median, round(avg(CAST(gain > 0 AS DOUBLE)), 4) AS win_rate, count(*) FILTER (WHERE gain < 0) AS worse FROM r",
    "rank_quantile_map": """WITH r AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS score, p_retailprice AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS i, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS j, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
      SELECT a.p_partkey, a.p_brand, a.score, round(a.value, 6) AS value, round(CASE WHEN a.n >= 3 THEN b.value ELSE a.score END, 6) AS mapped FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.i = b.j""",
    "recenter_group_median": """WITH s AS (SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.5) - quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS s FROM part GROUP BY 1)
      SELECT p_partkey, part.p_brand, CAST(p_size AS DOUBLE) AS pred, round(p_retailprice, 4) AS anchor, round(p_size + CASE WHEN n >= 3 THEN s ELSE 0 END, 4) AS recentred FROM part JOIN s ON part.p_brand = s.p_brand""",
    "prior_fallback": """WITH t AS (SELECT * FROM part WHERE p_partkey % 7 = 0), a AS (SELECT p_type, avg(p_retailprice) AS m FROM t GROUP BY 1), b AS (SELECT p_brand, avg(p_retailprice) AS m FROM t GROUP BY 1)
      SELECT p_partkey, part.p_brand, part.p_type, round(coalesce(a.m, b.m, (SELECT avg(p_retailprice) FROM t)), 4) AS prior FROM part LEFT JOIN a ON a.p_type = part.p_type LEFT JOIN b ON b.p_brand = part.p_brand""",
    "blend_columns": f"""WITH j AS ({_PRED}), p AS (SELECT id, run, avg(pred) AS x, CASE run WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0.1 END AS w FROM j GROUP BY 1, 2) SELECT id, round(CAST(sum(w * x) / sum(w) AS DOUBLE), 4) AS blend FROM p GROUP BY 1""",
    "candidate_ranking": f"""WITH j AS ({_PRED}), b AS (SELECT id, round(avg(pred), 3) AS m, round(coalesce(stddev_samp(pred), 0), 3) AS s FROM j GROUP BY 1),
      r AS (SELECT id, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rm, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, count(*) OVER () AS n FROM b)
      SELECT id, round(0.6 * rm / n + 0.4 * rs / n, 5) AS score FROM r""",
    "best_offset": f"""WITH j AS ({_PRED}), g AS (SELECT p_brand, CAST(o * 50 AS INT) AS "offset", round(avg(abs(target - pred - o * 50)), 6) AS mae FROM j, range(-10, 11) AS t(o) GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY mae, "offset") AS k FROM g) SELECT p_brand, "offset", round(mae, 4) AS mae FROM k WHERE k = 1""",
}
