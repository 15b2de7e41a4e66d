"""Table shaping, row filters, and exact quantiles that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.session import discard, materialise


def pick(df: DataFrame, wanted: list[str], mandatory: list[str] = (), prefix: str = "", keys: list[str] = ()) -> DataFrame:
    """The wanted columns that exist, prefixed but for keys; a mandatory one that is missing raises."""
    if missing := [c for c in mandatory if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(c).alias(c if c in keys else prefix + c) for c in wanted if c in df.columns))


def shape(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns (name -> type), in order; absent ones are null, lists become JSON where a string is asked for."""
    own = dict(df.dtypes)

    def of(name: str, kind: str) -> Column:
        if name not in own:
            return F.lit(None).cast(kind).alias(name)
        return (F.to_json(name) if own[name].startswith(("array", "map", "struct")) and kind == "string" else F.col(name).cast(kind)).alias(name)

    return df.select(*(of(c, k) for c, k in columns.items()))


def differences(df: DataFrame, left: str = "F_", right: str = "O_", out: str = "D_") -> DataFrame:
    """df and out + x = left + x minus right + x, for every x that has both columns."""
    both = [c[len(left) :] for c in df.columns if c.startswith(left) and right + c[len(left) :] in df.columns]
    return df.select("*", *((F.col(left + x) - F.col(right + x)).alias(out + x) for x in both))


def choose(first: str, second: str, mode: str) -> Column:
    """A target from two sources: first_preferred, second_preferred, first_only or second_only."""
    return {"first_preferred": F.coalesce(first, second), "second_preferred": F.coalesce(second, first), "first_only": F.col(first), "second_only": F.col(second)}[mode]


def first_existing(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that df has; null if it has none."""
    return next((F.col(c) for c in names if c in df.columns), F.lit(None))


def merged_alias(names: list[str], low: float, high: float) -> Column:
    """The first non-null of the named columns, null outside [low, high]."""
    value = F.coalesce(*names)
    return F.when(value.between(low, high), value)


def in_ranges(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """A mask: each column not null and inside its bounds, None being open."""
    mask = F.lit(True)
    for c, (low, high) in ranges.items():
        mask = mask & F.col(c).isNotNull()
        mask = mask & (F.col(c) >= low) if low is not None else mask
        mask = mask & (F.col(c) <= high) if high is not None else mask
    return mask


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation over all non-null values of a column.

    Values are counted first, so that equal ones are one row, and dealt by range to partitions. Only a total for each
    partition comes to the driver; of the partitions that hold the wanted ranks, running counts give the values. No task
    holds more than its range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).count()
    counts = materialise(counts.repartitionByRange("v").select("v", "count", F.spark_partition_id().alias("part")), "counts")
    totals = counts.groupBy("part").agg(F.sum("count").alias("n"), F.min("v").alias("v")).orderBy("v").collect()
    n = sum(r["n"] for r in totals)
    if not n:
        return [None] * len(shares)
    places = {int(p) + k for q in shares for p in [q * (n - 1)] for k in (0, 1) if int(p) + k < n}
    wanted, before = [], 0
    for r in totals:
        if own := sorted(p - before for p in places if before <= p < before + r["n"]):
            wanted += [(r["part"], p, p + before) for p in own]
        before += r["n"]
    asked = df.sparkSession.createDataFrame(wanted, "part int, at long, place long")  # two places for each share
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(F.broadcast(asked.select("part").distinct()), "part").withColumn("upto", F.sum("count").over(upto))
    found = run.join(F.broadcast(asked), "part").where("at < upto and at >= upto - count").select("place", "v").collect()
    at = {r["place"]: r["v"] for r in found}
    discard(counts)
    out = []
    for q in shares:
        p = q * (n - 1)
        low, high = at[int(p)], at.get(int(p) + 1, at[int(p)])
        out.append(low + (high - low) * (p - int(p)))
    return out


def quantile_range(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """The rows whose listed columns all lie between their quantiles in df."""
    bounds = {c: tuple(exact_quantiles(df, c, [low, high])) for c in columns}
    return df.where(in_ranges(bounds))


def column_report(df: DataFrame, columns: list[str], least: int = 5, most_null: float = 0.95) -> DataFrame:
    """A row for each column: name, n (values), null_share, levels, usable (enough values, few enough nulls, two levels or more); one pass."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(c)).alias("levels")) for c in columns]
    each = df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    share = F.coalesce(1 - F.col("n") / F.when(F.col("rows") > 0, F.col("rows")), F.lit(1.0))
    return each.select("name", "n", share.alias("null_share"), "levels", ((F.col("n") >= least) & (share < most_null) & (F.col("levels") >= 2)).alias("usable"))
