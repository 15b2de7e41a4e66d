"""Prediction runs to one prediction an id, and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.operators.ranks import with_quantiles


def by_id(runs: DataFrame, key: str, pred: str, weight: str | None = None) -> DataFrame:
    """count, mean, median, std (0 for one run), range, trimmed mean (a tenth of the order statistics off each end, from 5 runs) and, given weights, weighted mean (null where they sum to 0)."""
    sorted_preds = F.array_sort(F.collect_list(pred))  # one list an id: as many entries as runs
    out = [F.count(pred).alias("n"), F.avg(pred).alias("mean"), F.percentile(pred, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(pred), F.lit(0.0)).alias("std"), (F.max(pred) - F.min(pred)).alias("range"), sorted_preds.alias("all_")]
    if weight:
        use = F.when(F.col(pred).isNotNull(), F.col(weight))
        out.append((F.sum(use * F.col(pred)) / F.nullif(F.sum(use), F.lit(0.0))).alias("weighted"))
    k = F.when(F.col("n") < 5, 0).otherwise(F.floor(F.col("n") * 0.1)).cast("int")
    kept = F.slice("all_", k + 1, F.greatest((F.col("n") - 2 * k).cast("int"), F.lit(1)))
    trimmed = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))
    return runs.groupBy(key).agg(*out).withColumn("trimmed", trimmed).drop("all_")


def rank_quantile_map(df: DataFrame, group: str, score: str, values: str, tie: str, least: int = 3) -> DataFrame:
    """Within each group the i-th smallest value goes to the i-th lowest score (column mapped); groups of fewer than least rows keep the score."""
    by_score, by_value = Window.partitionBy(group).orderBy(score, tie), Window.partitionBy(group).orderBy(values, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    left = df.withColumn("i_", F.row_number().over(by_score)).withColumn("n_", n)
    right = df.select(F.col(group).alias("g_"), F.row_number().over(by_value).alias("j_"), F.col(values).alias("v_"))
    both = left.join(right, (F.col(group) == F.col("g_")) & (F.col("i_") == F.col("j_")), "left")
    return both.withColumn("mapped", F.when(F.col("n_") >= least, F.col("v_")).otherwise(F.col(score))).drop("i_", "n_", "g_", "j_", "v_")


def recenter(df: DataFrame, group: str, pred: str, anchor: str, least: int = 3) -> DataFrame:
    """pred moved by median(anchor) - median(pred) of its group, where that has least rows (column recentred)."""
    many = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_"))
    both = with_quantiles(with_quantiles(many, df, [group], anchor, {"a_": 0.5}), df, [group], pred, {"p_": 0.5})
    shift = both.select(group, "n_", (F.col("a_") - F.col("p_")).alias("s_"))
    return df.join(shift, group).withColumn("recentred", F.col(pred) + F.when(F.col("n_") >= least, F.col("s_")).otherwise(0.0)).drop("n_", "s_")


def fallback_prior(train: DataFrame, rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """rows with prior: the mean target of the first key's group, else the next key's, else of all of train."""
    out = rows
    for i, k in enumerate(keys):
        out = out.join(train.groupBy(k).agg(F.avg(target).alias(f"p{i}_")), k, "left")
    out = out.crossJoin(F.broadcast(train.agg(F.avg(target).alias("all_"))))  # one row
    return out.withColumn("prior", F.coalesce(*(f"p{i}_" for i in range(len(keys))), "all_")).drop("all_", *(f"p{i}_" for i in range(len(keys))))


def blend(columns: dict[str, float]) -> Column:
    """The weighted mean of the columns that are present in a row, weights renormalised; null where none is."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in columns.items()), F.lit(0.0))
    return top / F.nullif(sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in columns.items()), F.lit(0.0)), F.lit(0.0))


def filter_runs(scores: DataFrame, keep: Column, least: int) -> DataFrame:
    """The runs that pass; all runs if fewer than least do."""
    marked = scores.withColumn("ok_", F.coalesce(keep, F.lit(False)))
    enough = marked.agg((F.count_if("ok_") >= least).alias("enough_"))
    return marked.crossJoin(F.broadcast(enough)).where("ok_ or not enough_").drop("ok_", "enough_")
