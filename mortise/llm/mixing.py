"""Operator 10: sources mixed to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of tokens raised to an exponent a, normalised; a = 1 keeps the shares, a = 0 evens them out.
Bisection finds the smallest a in [0, 1] for which no source is repeated more than MAX_REPEATS times within the budget (or, given an
entropy, the a that meets it). Each round of it is two aggregations over the table of sources that try a grid of exponents at once, from which a few
numbers return, so any number of sources will do.

A source's quota is its weight times the budget of tokens. Its documents are dealt by hash to blocks of about
BLOCK documents, and the blocks put in hash order; inside a block documents follow in hash order. The source gives
all its documents as often as the quota holds its tokens, and once more those before the point where the rest
of the quota is used up. Sums run over blocks first and then inside each block, so a source with a third of all
rows is never in one task.

Tokens are words split at ASCII white space, at least one a document. A null source is a source of its own. Null and empty texts
count one token; a very long text is a row like others. Rows that share a doc_id are ordered by their text's hash; equal rows are interchangeable. An empty
table gives an empty result. Extra columns pass through; see mix() for those whose names clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from mortise.llm.graph import bounded_broadcast
from mortise.session import materialise

MAX_REPEATS = 2.0
BLOCK = 4_000
GRID, ROUNDS = 31, 8  # 31 midpoints are five halvings; eight rounds are 40
SEED = 17


def _n_tokens(text: str) -> F.Column:
    return F.greatest(F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(1)).cast("long")


def exponent(sources: DataFrame, budget: float, max_repeats: float = MAX_REPEATS, entropy: float | None = None) -> float:
    """sources (tokens) -> the exponent; 1 where even the shares themselves repeat too much or have too little entropy.

    Bisection, five halvings a round: the GRID midpoints that five halvings can meet are tried in one aggregation, and the bounds drawn together around the first that holds.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def measured(tried: list[float]) -> list[bool]:
        sums = sources.agg(*(F.sum(F.pow(share, F.lit(a))).alias(f"n{k}") for k, a in enumerate(tried))).first()
        weight = [F.pow(share, F.lit(a)) / F.lit(sums[k]) for k, a in enumerate(tried)]
        if entropy is None:
            most = sources.agg(*(F.max(w * budget / F.col("tokens")).alias(f"r{k}") for k, w in enumerate(weight))).first()
            return [r <= max_repeats * (1 + 1e-12) for r in most]
        return [e <= entropy for e in sources.agg(*(F.sum(-w * F.ln(w)).alias(f"e{k}") for k, w in enumerate(weight))).first()]

    low, high = 0.0, 1.0
    if measured([low])[0]:
        return low
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / (GRID + 1) for k in range(1, GRID + 1)]
        holds = measured(tried)
        at = holds.index(True) if True in holds else GRID
        low, high = ([low, *tried][at], [*tried, high][at])
    return high


def mix(docs: DataFrame, budget_share: float = 1.0, max_repeats: float = MAX_REPEATS, entropy: float | None = None, block: int = BLOCK, columns: list[str] | None = None) -> DataFrame:
    """The rows of docs that are drawn (only the given columns, or all), with n_tokens, weight, copies (times the row is drawn, 1 or more), block and turn (its rank in the source's permutation of blocks, and in the block).

    budget_share is the budget as a share of docs' tokens. A column of docs that has one of these names keeps its values as in_<name>.
    """
    own = [F.col(f"`{c}`") for c in (columns if columns is not None else docs.columns)]
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0null"))
    rows = docs.select(F.struct(*own).alias("row"), source.alias("s"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"), _n_tokens("text").alias("n"))
    sources = materialise(rows.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    a = exponent(sources, budget_share * total, max_repeats, entropy)
    norm = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(norm)
    quota = F.round(weight * F.lit(budget_share * total)).cast("long")
    plan = materialise(sources.select("s", weight.alias("weight"), F.floor(quota / F.col("tokens")).alias("whole"), (quota % F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / block).alias("blocks")), "plan")
    dealt = rows.join(bounded_broadcast(plan), "s").withColumn("b", F.pmod(F.xxhash64(F.lit(SEED + 1), "h"), F.col("blocks")))
    sums = dealt.groupBy("s", "b").agg(F.sum("n").alias("own"))
    by_source = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(SEED + 2), "s", "b"), "b")
    sums = sums.select("s", "b", F.row_number().over(by_source).alias("block"), (F.sum("own").over(by_source) - F.col("own")).alias("before"))
    in_block = Window.partitionBy("s", "b").orderBy("h")
    placed = dealt.withColumn("turn", F.row_number().over(in_block)).withColumn("upto", F.sum("n").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(sums, ["s", "b"])
    copies = F.col("whole") + (F.col("before") + F.col("upto") <= F.col("rest")).cast("long")
    drawn = placed.withColumn("copies", copies).where("copies > 0")
    extra = {"n_tokens": F.col("n"), "weight": F.col("weight"), "copies": F.col("copies"), "block": F.col("block").cast("long"), "turn": F.col("turn").cast("long")}
    taken = {k.lower() for k in extra}
    names = columns if columns is not None else docs.columns
    return drawn.select(*(F.col("row")[c].alias(f"in_{c}" if c.lower() in taken else c) for c in names), *(v.alias(k) for k, v in extra.items()))


def entropy_of(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)
