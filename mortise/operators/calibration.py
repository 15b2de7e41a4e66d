"""Calibration of predictions, fold-safe encodings, sample weights and classification measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.operators.ranks import with_quantiles
from mortise.operators.shaping import exact_quantiles


def target_encoding(df: DataFrame, group: str, fold: str, target: str) -> DataFrame:
    """df with encoded: the mean target of the row's group outside the row's fold; where the group has no other fold, the mean of all rows outside the fold."""
    own = df.groupBy(group, fold).agg(F.sum(target).alias("s_"), F.count(target).alias("n_"))
    by_group, by_fold = own.groupBy(group).agg(F.sum("s_").alias("gs_"), F.sum("n_").alias("gn_")), own.groupBy(fold).agg(F.sum("s_").alias("fs_"), F.sum("n_").alias("fn_"))
    total = own.agg(F.sum("s_").alias("ts_"), F.sum("n_").alias("tn_"))  # one row
    rates = own.join(by_group, group).join(by_fold, fold).crossJoin(F.broadcast(total))
    others = F.try_divide(F.col("gs_") - F.coalesce("s_", F.lit(0.0)), F.nullif(F.col("gn_") - F.col("n_"), F.lit(0)))
    rest = F.try_divide(F.col("ts_") - F.coalesce("fs_", F.lit(0.0)), F.nullif(F.col("tn_") - F.col("fn_"), F.lit(0)))
    return df.join(rates.select(group, fold, F.coalesce(others, rest).alias("encoded")), [group, fold], "left")


def affine(df: DataFrame, group: str, pred: str, target: str, least: int = 5) -> DataFrame:
    """df with calibrated: intercept + slope * pred by least squares in the row's group; pred itself in groups of fewer than least rows or with one value of pred."""
    fit = df.groupBy(group).agg(F.regr_slope(target, pred).alias("b_"), F.regr_intercept(target, pred).alias("a_"), F.regr_count(target, pred).alias("n_"))
    fit = fit.where((F.col("n_") >= least) & F.col("b_").isNotNull() & F.col("a_").isNotNull()).drop("n_")
    return df.join(fit, group, "left").withColumn("calibrated", F.coalesce(F.col("a_") + F.col("b_") * F.col(pred), F.col(pred))).drop("a_", "b_")


def shrunken_offset(df: DataFrame, group: str, pred: str, target: str, k: float = 8.0, limit: float = 1.0) -> DataFrame:
    """df with calibrated: pred plus the group's median residual, clipped to limit and shrunk by n / (n + k)."""
    r = F.col(target) - F.col(pred)
    known = df.where(r.isNotNull()).select(group, r.alias("r_"))
    fit = with_quantiles(known.groupBy(group).agg(F.count("r_").alias("n_")), known, [group], "r_", {"m_": 0.5})
    shift = F.greatest(F.least(F.col("m_"), F.lit(limit)), F.lit(-limit)) * F.col("n_") / (F.col("n_") + k)
    return df.join(fit.select(group, shift.alias("s_")), group, "left").withColumn("calibrated", F.col(pred) + F.coalesce("s_", F.lit(0.0))).drop("s_")


def ridge_blend(df: DataFrame, target: str, first: str, second: str, penalty: float = 1.0) -> DataFrame:
    """One row: n and the weights w1, w2 of the ridge regression of target on two prediction columns without intercept, from the sums of their products."""
    ok = F.col(target).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull()
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = df.where(ok).agg(F.count(F.lit(1)).alias("n"), (dot(first, first) + penalty).alias("a"), dot(first, second).alias("b"), (dot(second, second) + penalty).alias("d"), dot(first, target).alias("u"), dot(second, target).alias("v"))
    det = F.nullif(F.col("a") * F.col("d") - F.col("b") * F.col("b"), F.lit(0.0))
    return s.select("n", F.try_divide(F.col("d") * F.col("u") - F.col("b") * F.col("v"), det).alias("w1"), F.try_divide(F.col("a") * F.col("v") - F.col("b") * F.col("u"), det).alias("w2"))


def multi_level(rows: DataFrame, train: DataFrame, levels: list[tuple[list[str], float]], target: str, shrink: float = 10.0, overall: float = 0.08) -> DataFrame:
    """rows with looked_up: the weighted mean of the levels' group medians; a level weighs base * min(1, n / shrink), the median of all rows weighs overall."""
    top, bottom, out = F.lit(0.0), F.lit(0.0), rows
    for i, (keys, base) in enumerate(levels):
        own = with_quantiles(train.groupBy(*keys).agg(F.count(target).alias(f"n{i}_")), train, keys, target, {f"m{i}_": 0.5})
        out = out.join(own, keys, "left")
        w = F.coalesce(F.lit(base) * F.least(F.lit(1.0), F.col(f"n{i}_") / shrink), F.lit(0.0))
        top, bottom = top + w * F.coalesce(f"m{i}_", F.lit(0.0)), bottom + w
    middle = F.lit(exact_quantiles(train, target, [0.5])[0]).cast("double")
    return out.withColumn("looked_up", (top + overall * middle) / (bottom + overall)).select(*rows.columns, "looked_up")


def inverse_frequency(df: DataFrame, keys: list[str], power: float = 0.5) -> DataFrame:
    """df with weight: (1 / frequency of the row's keys) ^ power, with a mean of 1. Counts by key are all that is shuffled."""
    own = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).withColumn("w_", F.pow(1.0 / F.col("n_"), F.lit(power)))
    mean = own.agg((F.sum(F.col("n_") * F.col("w_")) / F.sum("n_")).alias("m_"))
    own = own.crossJoin(F.broadcast(mean)).select(*keys, (F.col("w_") / F.col("m_")).alias("weight"))
    return df.join(own, keys)


def capped_inverse_weights(df: DataFrame, score: str, floor: float = 0.05, cap: float = 0.9) -> DataFrame:
    """df with weight: 1 / max(score - lowest + floor, floor), capped at that quantile of itself, summing to 1."""
    low = df.agg(F.min(score).alias("low_"))
    raw = df.crossJoin(F.broadcast(low)).withColumn("w_", 1.0 / F.greatest(F.col(score) - F.col("low_") + floor, F.lit(floor)))
    capped = raw.withColumn("w_", F.least("w_", F.lit(exact_quantiles(raw, "w_", [cap])[0]).cast("double")))
    return capped.crossJoin(F.broadcast(capped.agg(F.sum("w_").alias("sum_")))).withColumn("weight", F.col("w_") / F.col("sum_")).drop("w_", "low_", "sum_")


def guarded_blend(anchor: str, model: str, weight: float, limit: float) -> Column:
    """anchor + weight * (model - anchor), the difference clipped to limit."""
    return F.col(anchor) + weight * F.greatest(F.least(F.col(model) - F.col(anchor), F.lit(limit)), F.lit(-limit))


def rank_z_map(df: DataFrame, group: str, score: str, values: str, rank: Column) -> DataFrame:
    """df with mapped: the group's mean of values plus their population deviation times the standardised rank of score (0 where ranks don't vary)."""
    ranked = df.withColumn("r_", rank)
    own = ranked.groupBy(group).agg(F.avg(values).alias("m_"), F.stddev_pop(values).alias("s_"), F.avg("r_").alias("rm_"), F.stddev_pop("r_").alias("rs_"))
    z = F.coalesce(F.try_divide(F.col("r_") - F.col("rm_"), F.nullif(F.col("rs_"), F.lit(0.0))), F.lit(0.0))
    return ranked.join(own, group).withColumn("mapped", F.col("m_") + F.col("s_") * z).drop("r_", "m_", "s_", "rm_", "rs_")


def stratified_holdout(df: DataFrame, group: str, key: str, share: float, seed: str = "0") -> DataFrame:
    """df with held_out: of each group max(1, min(round(n share), n - 1)) rows, those first by MD5 of seed and key; none of a group of one."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    quota = F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.round(n * share).cast("long"), n - 1)))
    return df.withColumn("held_out", F.row_number().over(order) <= quota)


def classification(df: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """For each group (or all rows) tp, fp, fn, tn, accuracy, balanced, f1, mcc and kappa; a measure without a denominator is null. Rows with a null truth or answer are left out."""
    known = df.where(truth.isNotNull() & said.isNotNull())
    count = lambda a, b: F.count_if((truth == F.lit(a)) & (said == F.lit(b))).cast("double")
    c = known.groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    chance = (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)
    return c.select(
        *keys, *(F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")), div(tp + tn, n).alias("accuracy"), ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"), div(n * (tp + tn) - chance, n * n - chance).alias("kappa"),
    )
