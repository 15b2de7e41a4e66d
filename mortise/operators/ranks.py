"""Exact places in an order without gathering a group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.session import materialise


def numbered(df: DataFrame, order: list[Column], by: list[str] = [], place: str = "place") -> DataFrame:  # noqa: B006
    """df with the place (long, from 0) of each row in the order, in all or for each value of the columns by.

    Rows are dealt to partitions by range of (by, order), sorted there and stored; a row's place is its distance from the first row of its
    group in the partition, and the group's rows in the partitions before. Only a count for each partition and group is
    joined. The order should end in a unique column: rows that are equal in it share a partition, and their places are arbitrary among them.
    Null values of by are a group.
    """
    groups = {f"_g{i}": F.col(c) for i, c in enumerate(by)}
    sort = [F.col(c) for c in groups] + order
    stored = materialise(df.withColumns(groups).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    many = stored.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = many.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"{g}s") for g in groups), "_first", before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}s"))
    return stored.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(place))


def group_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each name in shares: the exact, linearly interpolated quantile of each group's non-null values.

    Equal values are counted first; counts are dealt by range of (group, value), and running counts come from a total for each partition and
    group, so a group of any size is spread over partitions. Groups without a value are absent.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    stored = materialise(counts.repartitionByRange(*groups, "_v").select("*", F.spark_partition_id().alias("_part")), "counts")
    total = stored.groupBy(*groups, "_part").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_low"))
    # the parts of a group hold rising ranges of its values; there are as many rows here as parts and groups
    ordered = Window.partitionBy(*groups).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    parts = total.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"{g}s") for g in groups), F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("_all"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}s"))
    upto = F.sum("_c").over(Window.partitionBy("_part", *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    run = stored.withColumn("_upto", upto).join(parts, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    holds = lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_c"))
    picked = []
    for name, q in shares.items():
        spot = q * (F.col("_all") - 1)
        low = F.floor(spot)
        high = F.least(low + 1, F.col("_all") - 1)
        picked += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l_{name}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_h_{name}"), F.max(spot - low).alias(f"_f_{name}")]
    found = run.groupBy(*groups).agg(*picked)
    value_of = lambda n: F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")
    return found.select(*(F.col(g).alias(c) for c, g in zip(by, groups, strict=True)), *(value_of(n).alias(n) for n in shares))


def with_quantiles(grouped: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """grouped (a row for each value of by in df) with group_quantiles() of df; null where a group has no value."""
    found = group_quantiles(df, by, value, shares)
    renamed = found.select(*(F.col(c).alias(f"_j{i}") for i, c in enumerate(by)), *shares)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_j{i}"))
    return grouped.join(renamed, same, "left").drop(*(f"_j{i}" for i in range(len(by))))


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows up to and with each row in order of a column; rows that are equal in it count together.

    Rows are dealt by range; a row has its partition's running sum and the sums of the partitions before, of which there are as many as partitions.
    """
    stored = materialise(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = stored.groupBy("_part").agg(F.sum(value).alias("_sum"), F.min(order).alias("_low"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy(F.asc_nulls_first("_low")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order))
    return stored.withColumn(name, own).join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part").select(*df.columns, (F.col(name) + F.col("_before")).alias(name))
