"""Grouped statistics, outliers, correlations, effect sizes and metrics. Every function takes and returns DataFrames; groupings combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mortise.operators.ranks import running_sum, with_quantiles
from mortise.operators.shaping import exact_quantiles


def quantile(value: str, p: float) -> Column:
    """The exact, linearly interpolated quantile."""
    return F.percentile(value, F.lit(p))


def summary(value: str) -> list[Column]:
    """n, mean, std (sample), min, max of the non-null values."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")]


def clean_category(name: str) -> Column:
    """A category without blanks at its ends; null or empty becomes 'unknown'."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown"))


def group_summary(df: DataFrame, keys: list[str], value: str, min_n: int = 1) -> DataFrame:
    """summary(), median, q1 and q3 for each group, and delta: the group's median less that of all rows."""
    known = df.where(F.col(value).isNotNull()).withColumns({k: clean_category(k) for k in keys})
    (overall,) = exact_quantiles(known, value, [0.5])
    out = with_quantiles(known.groupBy(*keys).agg(*summary(value)).where(F.col("n") >= min_n), known, keys, value, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return out.select(*keys, "n", "mean", "median", "std", "q1", "q3", "low", "high", (F.col("median") - F.lit(overall).cast("double")).alias("delta"))


def outliers(df: DataFrame, value: str, times: float = 1.5, z: float = 3.5) -> DataFrame:
    """df with iqr_out (outside q1 - times IQR .. q3 + times IQR), mad_z (.6745 (x - median) / MAD, 0 when MAD is 0) and mad_out."""
    q1, q2, q3 = (F.lit(q).cast("double") for q in exact_quantiles(df, value, [0.25, 0.5, 0.75]))
    x, iqr = F.col(value), q3 - q1
    mad = F.lit(exact_quantiles(df.select(F.abs(x - q2).alias("d_")), "d_", [0.5])[0]).cast("double")
    score = F.when(mad == 0, 0.0).otherwise(0.6745 * (x - q2) / mad)
    return df.withColumns({"iqr_out": (x < q1 - times * iqr) | (x > q3 + times * iqr), "mad_z": score, "mad_out": F.abs(score) > z})


def average_rank(by: list[str], order: str) -> Column:
    """Rank with ties at their mean (pandas 'average')."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    ties = Window.partitionBy(*by, order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def metrics(target: str, pred: str) -> list[Column]:
    """n, mae, rmse, r2, pearson and bias over rows where both are present."""
    ok = F.col(target).isNotNull() & F.col(pred).isNotNull()
    t, p = F.when(ok, F.col(target)), F.when(ok, F.col(pred))
    e = p - t
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))).alias("r2"), F.corr(t, p).alias("pearson"), F.avg(e).alias("bias"),
    ]


def cliffs_delta(df: DataFrame, group: str, value: str) -> DataFrame:
    """(#greater - #less) / (n1 n0) over all pairs of group 1 and group 0, from counts by distinct value: a running sum in place of pairs."""
    c = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b"))
    placed = running_sum(c, value, "b", "upto").withColumn("below", F.col("upto") - F.col("b"))
    total = placed.agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(F.col("a") * F.col("below")).alias("gt"), F.sum(F.col("a") * F.col("b")).alias("eq"))
    return total.select("n1", "n0", F.try_divide(2 * F.col("gt") + F.col("eq") - F.col("n1") * F.col("n0"), F.col("n1") * F.col("n0")).alias("delta"))
