"""Predictions of several origins as one: gates, fused blends, means over repeated folds, and the quality of strategies and shots.

Nulls: a missing prediction takes no part in its row's blend, a missing measure none in its mean. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mortise.operators.ensembles import blend
from mortise.operators.ranks import running_sum, with_quantiles
from mortise.operators.shaping import exact_quantiles
from mortise.session import materialise


def average_places(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank (from 1) of its value in all rows, ascending; null for null. Ranks come from counts by value, so no task orders the whole table."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sum(counts, "_v", "_c", "_upto")
    return df.join(upto.select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name)), F.col(value) == F.col("_v"), "left").drop("_v")


def fuse(rows: DataFrame, base: tuple[str, float], gated: dict[str, float], source: DataFrame, target: str, most: float) -> DataFrame:
    """rows with fused, place and, for each gated column, its shift and whether it was used.

    A gated column takes part if the mean of its values is within most of the source target's mean; its values are moved so that its median is
    the base's. The blend is clipped to the range of the source target. Only a few numbers go through the driver.
    """
    name, weight = base
    stored = materialise(rows, "fusion")
    s = source.agg(F.avg(target).alias("mean"), F.min(target).alias("low"), F.max(target).alias("high")).first()
    means = stored.agg(*(F.avg(c).alias(c) for c in [name, *gated])).first()
    shift = {c: abs(means[c] - s["mean"]) if means[c] is not None and s["mean"] is not None else None for c in gated}
    used = {c: shift[c] is not None and shift[c] <= most for c in gated}
    middle = {c: exact_quantiles(stored, c, [0.5])[0] if means[c] is not None else None for c in [name, *(c for c in gated if used[c])]}
    moved = {c: F.col(c) + (F.lit(middle[name] - middle[c]) if middle[name] is not None else 0.0) for c in gated if used[c]}
    out = stored.withColumns({f"_moved_{c}": v for c, v in moved.items()}) if moved else stored
    fused = blend({name: weight} | {f"_moved_{c}": gated[c] for c in moved})
    if s["low"] is not None:
        fused = F.when(fused.isNotNull(), F.least(F.greatest(fused, F.lit(float(s["low"]))), F.lit(float(s["high"]))))
    out = out.withColumn("fused", fused).drop(*(f"_moved_{c}" for c in moved))
    out = out.withColumns({f"{c}_shift": F.lit(shift[c]).cast("double") for c in gated} | {f"{c}_used": F.lit(int(used[c])) for c in gated})
    return average_places(out, "fused", "place")


def strategy_quality(members: DataFrame, strategy: str, weight: str, measures: list[str]) -> DataFrame:
    """A row for each strategy: n, the weighted mean of each measure over the members that have it, and coverage: the share with the first one.

    A missing weight is 0; where a strategy's weights do not sum to more than 0, all its members weigh 1. A mean is null where its members' weights sum to 0.
    """
    clean = {m: F.when(~F.isnan(m), F.col(m)) for m in measures}
    own = F.coalesce(F.when(~F.isnan(weight), F.col(weight)), F.lit(0.0))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(own).alias("_w")]
    for i, m in enumerate(measures):
        has = clean[m].isNotNull()
        sums += [F.sum(F.when(has, own)).alias(f"_w{i}"), F.sum(own * clean[m]).alias(f"_x{i}"), F.avg(clean[m]).alias(f"_a{i}"), F.count(clean[m]).alias(f"_n{i}")]
    each = members.groupBy(strategy).agg(*sums)
    mean = lambda i: F.when(F.col("_w") > 0, F.col(f"_x{i}") / F.nullif(F.col(f"_w{i}"), F.lit(0.0))).otherwise(F.col(f"_a{i}"))
    return each.select(strategy, "n", *(mean(i).alias(f"mean_{m}") for i, m in enumerate(measures)), (F.col("_n0") / F.col("n")).alias("coverage"))


def fold_of(group: Column, repeat: Column, folds: int) -> Column:
    """A group's fold in a repeat, from 0: equal for all its rows and at every size."""
    digest = F.md5(F.concat_ws(":", F.coalesce(group.cast("string"), F.lit("")), repeat.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds))


def _line(n: Column, x: Column, y: Column, xx: Column, xy: Column) -> tuple[Column, Column]:
    """Intercept and slope of least squares from sums; a flat line where x does not vary."""
    spread = n * xx - x * x
    slope = F.when(spread > 1e-9 * n * xx, (n * xy - x * y) / spread).otherwise(0.0)
    return (y - slope * x) / n, slope


def repeated_folds(rows: DataFrame, key: str, group: str, x: str, y: str, repeats: int = 3, folds: int = 5, full: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """Two tables. For each row (key unique): oof, the mean over repeats of its prediction by the line fitted without its fold, and blended: full times the
    line of all rows and the rest the mean of all the folds' lines. For all rows: mae_mean and mae_std (of the population) of the repeats.

    A fold's line comes from the sums of all rows less its own, so every repeat and fold is fitted in one pass over the rows; rows
    without x or y fit nothing, and those without y are no part of the errors. Groups, not rows, are dealt to folds.
    """
    stored = materialise(rows.select(key, group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "fold-rows")
    spread = stored.withColumn("repeat", F.explode(F.array(*map(F.lit, range(repeats))))).withColumn("fold", fold_of(F.col(group), F.col("repeat"), folds))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    names = ("n", "sx", "sy", "sxx", "sxy")
    values = (F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"))
    sums = materialise(spread.where(both).groupBy("repeat", "fold").agg(*(F.sum(v).alias(k) for k, v in zip(names, values, strict=True))), "fold-sums")  # repeats times folds rows
    total = sums.groupBy("repeat").agg(*(F.sum(k).alias(f"{k}_all") for k in names))
    a, b = _line(*(F.col(f"{k}_all") - F.col(k) for k in names))
    lines = sums.join(total, "repeat").where(F.col("n_all") > F.col("n")).select("repeat", "fold", a.alias("a"), b.alias("b"))
    a_all, b_all = _line(*(F.col(f"{k}_all") for k in names))
    whole = total.where("repeat = 0").select(a_all.alias("a_all"), b_all.alias("b_all"))
    mean = lines.agg(F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"))
    held = spread.join(F.broadcast(lines), ["repeat", "fold"], "left").withColumn("p", F.col("a") + F.col("b") * F.col("x"))
    by_row = held.groupBy(key).agg(F.avg("p").alias("oof"))
    ends = stored.select(key, "x").crossJoin(F.broadcast(mean)).join(F.broadcast(whole), F.lit(True), "left")  # one row each
    blended = full * (F.col("a_all") + F.col("b_all") * F.col("x")) + (1 - full) * (F.col("a_mean") + F.col("b_mean") * F.col("x"))
    errors = held.groupBy("repeat").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"))
    return ends.select(key, blended.alias("blended")).join(by_row, key), errors


def shot_summary(details: DataFrame, shot: str, error: str, order: str, run: str) -> DataFrame:
    """A row for each shot: n, mean, std, median, q10 and q90 of the error, and the run of least error (then highest order, then least run) with both figures."""
    e = F.when(~F.isnan(error), F.col(error))
    first = F.min(F.when(e.isNotNull(), F.struct(e.alias("e"), (-F.coalesce(F.when(~F.isnan(order), F.col(order)), F.lit(float("-inf")))).alias("o"), F.col(run).alias("r"))))
    each = details.groupBy(shot).agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), first.alias("_b"))
    out = with_quantiles(each, details.where(~F.isnan(error)), [shot], error, {"median": 0.5, "q10": 0.1, "q90": 0.9})
    return out.select(shot, "n", "mean", "std", "median", "q10", "q90", F.col("_b.r").alias("best_run"), F.col("_b.e").alias("best_error"), (-F.nullif(F.col("_b.o"), F.lit(float("inf")))).alias("best_order"))
