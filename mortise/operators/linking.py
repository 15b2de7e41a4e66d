"""Joins with fallbacks, scored pairs, merges of records and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.session import materialise


def composite_join(a: DataFrame, b: DataFrame, keys: list[str], last: str, target: str) -> DataFrame:
    """a and b on keys and last, if last is set in every row of both, else on keys; b's target becomes other, mismatch marks pairs over 1e-6 apart."""
    full = all(df.agg(F.count(F.lit(1)) - F.count(last)).first()[0] == 0 for df in (a, b))
    on = [*keys, last] if full else keys
    both = a.join(b.select(*on, F.col(target).alias("other")), on)
    return both.withColumn("mismatch", F.coalesce(F.abs(F.col(target) - F.col("other")) > 1e-6, F.lit(False)))


def wide_predictions(long: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key, a column of the mean value for each name, and coverage: the share of names that have a value."""
    wide = long.groupBy(key).pivot(name, names).agg(F.avg(value))
    return wide.withColumn("coverage", sum((F.col(f"`{n}`").isNotNull().cast("int") for n in names), F.lit(0)) / len(names))


def cascade(ids: DataFrame, keys: DataFrame) -> DataFrame:
    """ids (id), keys (key) -> (id, key, how): the key equal to the id, else one that it starts with, else one inside it; the longest wins, then the first in order.

    Substrings of the ids that have the length of some key are joined by equality, so no pair of an id and an unlike key is made.
    """
    lengths = keys.select(F.collect_set(F.char_length("key")).alias("lengths"))  # at most one entry a key length
    at = F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("id") - n + 1, F.lit(1))), lambda i: F.struct(F.substring("id", i, n).alias("key"), i.alias("i")))))
    each = ids.select("id").distinct().crossJoin(F.broadcast(lengths)).select("id", F.explode(at).alias("x")).select("id", "x.key", "x.i")
    hits = each.join(keys.select("key").distinct(), "key")
    rank = F.when(F.col("key") == F.col("id"), 1).when(F.col("i") == 1, 2).otherwise(3)
    best = hits.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), (-F.char_length("key")).alias("short"), "key")).alias("best"))
    how = F.element_at(F.create_map(F.lit(1), F.lit("exact"), F.lit(2), F.lit("prefix"), F.lit(3), F.lit("inside")), F.col("best.rank"))
    return best.select("id", F.col("best.key").alias("key"), how.alias("how"))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared share of two arrays of tokens: of the smaller one; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


#: Rows of a block whose pairs are made together; those of larger blocks are dealt by key.
PAIR_ROWS = 1_000


def pair_scores(rows: DataFrame, key: str, block: list[str], tokens: str, same: dict[str, float], weight: float) -> DataFrame:
    """Pairs (a, b) with a < b of rows in one block, with score = weight * token overlap + the weights of equal columns, rounded to 4.

    Every pair is a row of the result, so it grows with the square of a block. Rows that agree in all that is scored are one class: a pair of classes is
    scored once and then gives its pairs of rows. A block is dealt by key to parts of PAIR_ROWS rows that meet each other, so no task holds more than two.
    """
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    own = rows.where(F.col(key).isNotNull()).select(*block, F.col(key).alias("key_"), F.col(tokens).alias("t_"), *(F.col(c).alias(f"s{k}_") for k, c in enumerate(same)))
    of = ["t_", *(f"s{k}_" for k in range(len(same)))]
    parts = own.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / PAIR_ROWS).cast("int").alias("parts_"))
    dealt = own.join(parts, block).withColumn("part_", F.pmod(F.xxhash64("key_"), F.col("parts_")).cast("int"))
    classes = dealt.repartition(spread, *block, "part_").groupBy(*block, "part_", "parts_", *of).agg(F.collect_list("key_").alias("keys"))
    groups = classes.groupBy(*block, "part_", "parts_").agg(F.collect_list(F.struct(F.split("t_", " ").alias("t"), *of[1:], "keys")).alias("cs"))
    large = groups.where("parts_ > 1")
    left = large.select(*block, F.col("cs").alias("left"), F.col("part_").alias("i_"), F.explode(F.expr("filter(sequence(0, parts_ - 1), j -> j > part_)")).alias("j_"))
    right = large.select(*block, F.col("cs").alias("right"), F.col("part_").alias("j_"), F.explode(F.expr("filter(sequence(0, parts_ - 1), i -> i < part_)")).alias("i_"))
    across = left.join(right.repartition(spread, *block, "i_", "j_"), [*block, "i_", "j_"]).select(F.lit(False).alias("within"), "left", "right")
    met = groups.select(F.lit(True).alias("within"), F.col("cs").alias("left"), F.col("cs").alias("right")).unionByName(across)
    met = met.select("within", "right", F.posexplode("left").alias("i", "l")).select("within", "i", "l", F.posexplode("right").alias("j", "r")).where("not within or i <= j")
    score = weight * token_overlap(F.col("l.t"), F.col("r.t"))
    for k, w in enumerate(same.values()):
        score = score + F.when(F.col(f"l.s{k}_").eqNullSafe(F.col(f"r.s{k}_")), w).otherwise(0.0)
    scored = met.select(F.expr("within and i = j").alias("one"), F.col("l.keys").alias("left"), F.col("r.keys").alias("right"), F.round(score, 4).alias("score"))
    each = scored.select("one", "score", "right", F.explode("left").alias("x")).select("one", "score", "x", F.explode("right").alias("y"))
    return each.where("x < y or (x > y and not one)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def merge_canonical(rows: DataFrame, keys: list[str], best: list[Column], keep: list[str], lists: list[str]) -> DataFrame:
    """One row for each key: keep's values from the best row (by the columns of best, largest first), distinct values of lists, sorted, and n."""
    top = F.max(F.struct(*best, F.struct(*keep).alias("keep"))).alias("top")
    out = rows.groupBy(*keys).agg(top, F.count(F.lit(1)).alias("n"), *(F.array_sort(F.collect_set(c)).alias(c + "_all") for c in lists))
    return out.select(*keys, "n", *(F.col(f"top.keep.{c}").alias(c) for c in keep), *(F.col(c + "_all") for c in lists))


def preferred(rows: DataFrame, keys: list[str], policy: str, quality: Column, new: str) -> DataFrame:
    """One row for each key by policy: new, old, quality_then_new or quality_then_old. Ties go to the row that compares largest in all columns."""
    order = {"new": [F.col(new)], "old": [-F.col(new)], "quality_then_new": [quality, F.col(new)], "quality_then_old": [quality, -F.col(new)]}[policy]
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.struct(*rest).alias("row"))).alias("best"))
    return best.select(*keys, "best.row.*")


def with_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """df and on every row its group's n, mean, std, lowest and highest value, and the whole table's mean."""
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return df.join(stats, group, "left").crossJoin(F.broadcast(df.agg(F.avg(value).alias("all_mean"))))  # one row


def normalised(df: DataFrame, weight: Column, by: list[str] = ()) -> DataFrame:
    """df and weight: invalid weights are 0, and those of a group sum to 1 (all 0 where none is valid)."""
    valid = F.when(weight.isNotNull() & ~F.isnan(weight) & (weight > 0), weight).otherwise(0.0)
    own = df.withColumn("raw_", valid)
    total = own.groupBy(*by).agg(F.sum("raw_").alias("total_"))
    both = own.join(total, list(by)) if by else own.crossJoin(F.broadcast(total))
    return both.withColumn("weight", F.when(F.col("total_") > 0, F.col("raw_") / F.col("total_")).otherwise(0.0)).drop("raw_", "total_")


def labelled_top(df: DataFrame, bucket: str, order: list[Column], k: int, prefix: Column) -> DataFrame:
    """The first k rows of each bucket with a label: the prefix and the place in the bucket."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k).withColumn("label", F.concat(prefix, F.col("place").cast("string")))


def audit(long: DataFrame, config: list[str], predicted: str, target: str) -> DataFrame:
    """mae, rmse and bias of each configuration, with best marking the one of least mae (then rmse, then name). The configurations are few; rows aren't."""
    error = F.col(predicted) - F.col(target)
    each = materialise(long.groupBy(*config).agg(F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias")), "audit")
    best = each.agg(F.min(F.struct("mae", "rmse", *config)).alias("b"))
    same = F.lit(True)
    for c in config:
        same = same & F.col(c).eqNullSafe(F.col(f"b.{c}"))
    return each.crossJoin(F.broadcast(best)).withColumn("best", same).drop("b")  # one row
