"""Fused blends, repeated folds, strategies and shots, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import fusion as fu
from mortise.plans.statistics import rounded
from mortise.session import table


def fused_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Three predictions of a part's quantity; the sum is far off and gated out."""
    l = table(spark, sf, "lineitem")
    n = F.count("l_quantity")
    p = l.groupBy("l_partkey").agg(F.when(n % 5 != 0, F.avg("l_quantity")).alias("base"), F.when(n % 3 != 0, F.max("l_quantity") - 10).alias("near"), F.sum("l_quantity").alias("far"))
    return rounded(fu.fuse(p, ("base", 0.5), {"near": 0.3, "far": 0.2}, l.where("l_returnflag = 'A'"), "l_quantity", 15.0), 6)


def strategy_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as strategies, line numbers as members; every fifth supplier has no weights."""
    m = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.when(F.count(F.lit(1)) % 4 != 0, F.stddev_samp("l_discount")).alias("rmse"), F.avg("l_tax").alias("mae"), F.when(F.col("l_suppkey") % 5 != 0, F.sum("l_quantity")).alias("weight"))
    return rounded(fu.strategy_quality(m, "l_suppkey", "weight", ["rmse", "mae"]), 7)


def _folds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Order totals by the number of lines, customers kept together."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    return fu.repeated_folds(table(spark, sf, "orders").join(lines, "o_orderkey", "left"), "o_orderkey", "o_custkey", "quantity", "o_totalprice")


def repeated_folds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_folds(spark, sf)[0], 3)


def repeated_fold_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_folds(spark, sf)[1], 3)


def shot_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as shots, suppliers as runs."""
    d = table(spark, sf, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.round(F.avg(F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity"))), 3).alias("mae"), F.round(F.avg("l_discount"), 4).alias("order"))
    return rounded(fu.shot_summary(d, "l_linenumber", "mae", "order", "l_suppkey"), 4)


QUERIES = {f.__name__: f for f in (fused_blend, strategy_quality, repeated_folds, repeated_fold_errors, shot_summary)}

_LINES = """d AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS y, CAST((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS DOUBLE) AS x FROM orders),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(o_custkey AS VARCHAR), '') || ':' || repeat), 1, 8) AS BIGINT) % 5 AS fold FROM d, range(3) t(repeat)),
f AS (SELECT a.repeat, a.fold, regr_intercept(b.y, b.x) AS a, regr_slope(b.y, b.x) AS b FROM (SELECT DISTINCT repeat, fold FROM h) a JOIN h b ON a.repeat = b.repeat AND a.fold <> b.fold GROUP BY 1, 2),
p AS (SELECT h.*, f.a + f.b * h.x AS p FROM h LEFT JOIN f USING (repeat, fold))"""

ORACLES = {
    "fused_blend": """WITH p AS (SELECT l_partkey, CASE WHEN count(l_quantity) % 5 <> 0 THEN avg(l_quantity) END AS base, CASE WHEN count(l_quantity) % 3 <> 0 THEN max(l_quantity) - 10 END AS near, sum(l_quantity) AS far FROM lineitem GROUP BY 1),
      s AS (SELECT avg(l_quantity) AS m, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_returnflag = 'A'),
      g AS (SELECT abs(avg(near) - any_value(m)) AS near_shift, abs(avg(far) - any_value(m)) AS far_shift, median(base) - median(near) AS up, any_value(low) AS low, any_value(high) AS high FROM p, s),
      b AS (SELECT p.*, near_shift, far_shift, low, high, (coalesce(0.5::DOUBLE * base, 0) + coalesce(0.3::DOUBLE * (near + up), 0)) / nullif(CASE WHEN base IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN near IS NULL THEN 0 ELSE 0.3::DOUBLE END, 0) AS f FROM p, g),
      c AS (SELECT *, CASE WHEN f IS NOT NULL THEN least(greatest(f, low), high) END AS fused FROM b)
      SELECT l_partkey, round(base, 6) AS base, round(near, 6) AS near, round(far, 6) AS far, round(near_shift, 6) AS near_shift, round(far_shift, 6) AS far_shift, CAST(near_shift <= 15 AS INT) AS near_used, CAST(far_shift <= 15 AS INT) AS far_used, round(fused, 6) AS fused,
        CASE WHEN fused IS NOT NULL THEN rank() OVER (ORDER BY fused) + (count(*) OVER (PARTITION BY fused) - 1) / 2 END AS place FROM c""",
    "strategy_quality": """WITH m AS (SELECT l_suppkey, l_linenumber, CASE WHEN count(*) % 4 <> 0 THEN stddev_samp(l_discount) END AS rmse, avg(l_tax) AS mae, CASE WHEN l_suppkey % 5 <> 0 THEN sum(l_quantity) ELSE 1 END AS w FROM lineitem GROUP BY 1, 2)
      SELECT l_suppkey, count(*) AS n, round(sum(w * rmse) / sum(w) FILTER (rmse IS NOT NULL), 7) AS mean_rmse, round(sum(w * mae) / sum(w), 7) AS mean_mae, round(count(rmse) / count(*), 7) AS coverage FROM m GROUP BY 1""",
    "repeated_folds": f"""WITH {_LINES}, w AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM d), m AS (SELECT avg(a) AS a, avg(b) AS b FROM f)
      SELECT o_orderkey, round(any_value(0.65::DOUBLE * (w.a + w.b * x) + 0.35::DOUBLE * (m.a + m.b * x)), 3) AS blended, round(avg(p), 3) AS oof FROM p, w, m GROUP BY 1""",
    "repeated_fold_errors": f"WITH {_LINES}, e AS (SELECT avg(abs(p - y)) AS mae FROM p GROUP BY repeat) SELECT round(avg(mae), 3) AS mae_mean, round(stddev_pop(mae), 3) AS mae_std FROM e",
    "shot_summary": """WITH d AS (SELECT l_linenumber, l_suppkey, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 3) AS mae, round(avg(l_discount), 4) AS o FROM lineitem GROUP BY 1, 2),
      b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY mae, o DESC, l_suppkey) = 1)
      SELECT d.l_linenumber, count(*) AS n, round(avg(d.mae), 4) AS mean, round(stddev_samp(d.mae), 4) AS std, round(median(d.mae), 4) AS median, round(quantile_cont(d.mae, 0.1), 4) AS q10, round(quantile_cont(d.mae, 0.9), 4) AS q90, any_value(b.l_suppkey) AS best_run, any_value(b.mae) AS best_error, any_value(b.o) AS best_order FROM d JOIN b USING (l_linenumber) GROUP BY 1""",
}
