"""Distributed union-find over links, and joins whose broadcast side is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mortise.session import discard, materialise

#: Rows of ids (one or two longs each) that may be broadcast: 2 million of them hold under 64 MB on an executor.
BROADCAST_ROWS = 2_000_000
#: How often a table may be read so that its keys need no shuffle.
PASSES = 8


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small; otherwise as it is, for a shuffle join. df should be a stored table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined_in_passes(df: DataFrame, keys: DataFrame, on: str) -> list[DataFrame]:
    """Frames that together are df.join(keys, on), to be stored one after the other; keys should be a stored table.

    Each has BROADCAST_ROWS keys or so to broadcast, so df is read once for each, but not shuffled. What would take more than PASSES is one shuffle join.
    """
    passes = -(-keys.count() // BROADCAST_ROWS)
    if passes < 2:
        return [df.join(F.broadcast(keys), on)]
    if passes > PASSES:
        return [df.join(keys, on)]
    own = F.pmod(F.xxhash64(on), F.lit(passes))
    return [df.join(F.broadcast(keys.where(own == k)), on) for k in range(passes)]


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every node with a link; root is the smallest node of its component.

    Each round points every node at the smallest of its neighbours, follows that pointer
    once more, and rewrites the links between the nodes pointed at. Links inside a merged group vanish, so
    the table of links shrinks round by round; the grouping is a min(), which is combined before the
    shuffle, so a node with many links is no burden. Rows with a null end, and links of a node
    with itself, are ignored. Nothing is collected.
    """
    links = materialise(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        near = materialise(near.select("node", F.least("node", "low").alias("to")), "near")
        far = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialise(near.join(far, "to").select("node", F.least("to", "far").alias("to")), "step")
        a = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        shorter = links.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        shorter = materialise(shorter.where("a <> b").distinct(), "links")
        if labels is None:
            merged = step.select("node", F.col("to").alias("root"))
        else:
            on = step.select(F.col("node").alias("root"), F.col("to"))
            merged = labels.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        merged = materialise(merged, "labels")
        discard(links, near, step, *([labels] if labels is not None else []))
        links, labels = shorter, merged
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
