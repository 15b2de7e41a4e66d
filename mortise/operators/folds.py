"""Folds of groups, dealt by places in an order of the group table. No group is in two folds, and no table of groups in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mortise.operators.ranks import numbered


def mixed(seed: int, *parts: Column) -> Column:
    """A text that orders rows at random, but always alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def snake(place: Column, k: int) -> Column:
    """0 .. k-1, k-1 .. 0, 0 ..: the fold of a place."""
    at = F.pmod(place, F.lit(2 * k))
    return F.least(at, 2 * k - 1 - at).cast("int")


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """group, n, stratum, fold: k folds of whole groups with balanced numbers of rows of each label.

    A stratum is all groups with about the same mixture of labels (shares in eighths, null being a label too). Its groups, largest first (ties
    in random order), are dealt to the folds in a snake that runs on into the next stratum. So in a stratum two folds' rows differ by at most
    twice its largest group, and a label's rows, over all strata, by the sum of that over the strata and what an eighth hides. Row order
    and partitions don't matter. Groups with a null key are one group.
    """
    counts = df.groupBy(F.col(group).alias("g_"), F.col(label).cast("string").alias("l_")).agg(F.count(F.lit(1)).alias("c_"))
    sizes = counts.groupBy("g_").agg(F.sum("c_").alias("n"))
    share = F.floor(8 * F.col("c_") / F.col("n") + 0.5).cast("int")
    # one row for each label of a group
    mixture = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("l_", F.lit("")), share.cast("string")))), ";")
    both = counts.withColumnRenamed("g_", "g2_").join(sizes, F.col("g_").eqNullSafe(F.col("g2_")))
    table = both.groupBy("g_", "n").agg(mixture.alias("stratum"))
    placed = numbered(table, [F.col("stratum"), F.desc("n"), mixed(seed, F.col("g_")), F.col("g_")])
    return placed.select(F.col("g_").alias(group), "n", "stratum", snake(F.col("place"), k).alias("fold"))


def repeated_group_folds(df: DataFrame, group: str, k: int = 5, repeats: int = 3, seed: int = 0) -> DataFrame:
    """repeat, group, fold: for each repeat the groups in another random order, dealt in strides, so that folds differ by one group at most."""
    each = df.select(group).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    placed = numbered(each, [mixed(seed, F.col("repeat"), F.col(group)), F.col(group)], ["repeat"])
    return placed.select("repeat", group, F.pmod("place", F.lit(k)).cast("int").alias("fold"))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """group, fold: each group a fold of its own, numbered in order of the group."""
    return numbered(df.select(group).distinct(), [F.col(group)]).select(group, F.col("place").alias("fold"))


def train_validation_test(df: DataFrame, group: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 0) -> DataFrame:
    """group, part: train, validation or test by the group's place in a random order, so that the shares of groups hold to within one group."""
    many = df.select(group).distinct()
    placed = numbered(many, [mixed(seed, F.col(group)), F.col(group)])
    n = F.lit(placed.count())
    return placed.select(group, F.when(F.col("place") < F.floor(shares[0] * n + 0.5), "train").when(F.col("place") < F.floor((shares[0] + shares[1]) * n + 0.5), "validation").otherwise("test").alias("part"))
