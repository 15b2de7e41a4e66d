"""Text operators: chunks, cues, budgets, evidence, TF-IDF retrieval, units."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.operators.records import by_key
from mortise.session import materialise

#: Factors to eV (fixed values).
TO_EV = {"ev": 1.0, "mev": 1 / 1000, "kj/mol": 1 / 96.4853321233, "kcal/mol": 1 / 23.0605478306, "j/mol": 1 / 96485.3321233}


def chunk_windows(df: DataFrame, key: str, text: str, size: int = 3600, overlap: int = 300, least: int = 30) -> DataFrame:
    """key, ordinal, start, piece: windows of size characters that overlap; the last one reaches the end, pieces under least characters are dropped."""
    n, step = F.char_length(text), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    at = df.where(n > 0).select(key, text, F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal"))
    piece = F.substring(F.col(text), F.col("ordinal") * step + 1, F.lit(size))
    return at.select(key, F.col("ordinal").cast("long"), (F.col("ordinal") * step).cast("long").alias("start"), piece.alias("piece")).where(F.char_length("piece") >= least)


def cue_counts(df: DataFrame, key: str, text: str, cues: dict[str, str]) -> DataFrame:
    """For each key, how many of its texts match each cue's pattern."""
    return df.groupBy(key).agg(*(F.count_if(F.col(text).rlike(p)).alias(f"cue_{c}") for c, p in cues.items()))


def prefix_budget(df: DataFrame, key: str, text: str, order: list[Column], budget: int) -> DataFrame:
    """Rows of each key in order while the running sum of length + 1 stays within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(F.char_length(text) + 1).over(w)).where(F.col("used") <= budget)


def to_ev(value: Column, unit: Column) -> Column:
    """Energy in eV, rounded to 6 places; a missing or unknown unit leaves the value."""
    u = F.lower(F.regexp_replace(F.coalesce(unit, F.lit("")), r"\s+", ""))
    out = value
    for name, factor in TO_EV.items():
        out = F.when(u == name, value * factor).otherwise(out)
    return F.round(out, 6)


#: Words that all tasks hold with their weights, the most frequent ones; rarer words are joined.
HELD_WORDS = 200_000


def _counted(texts: DataFrame, key: str) -> DataFrame:
    """key, words: each different word of the array parts with its count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = pc.list_flatten(lists).dictionary_encode()
            doc, wide = pc.list_parent_indices(lists).to_numpy().astype(np.int64), max(1, len(words.dictionary))
            own, tf = np.unique(doc * wide + words.indices.to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(own // wide, np.arange(batch.num_rows + 1))
            found = pa.StructArray.from_arrays([words.dictionary.take(pa.array(own % wide)), pa.array(tf)], names=["w", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=[key, "words"])

    return texts.mapInArrow(of, f"`{key}` {dict(texts.dtypes)[key]}, words array<struct<w: string, tf: bigint>>")


def tfidf_cosine(docs: DataFrame, key: str, text: str, query: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """key, cosine: smoothed TF-IDF, L2-normalised, against the query's words; only documents that share a word. N and df cover docs, and the query's weights use them.

    A document's words are counted in the task that holds its row. The weights of the HELD_WORDS most frequent words go to all tasks; only the rarer words
    of documents that share a word with the query are shuffled to their weights.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(*stop_words))
    texts = by_key(docs, key, tokens, F.flatten)
    n = docs.agg(F.count(F.lit(1)).alias("n_"))
    df = _counted(texts, key).select(F.explode("words.w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = materialise(df.crossJoin(F.broadcast(n)).select("w", "df", (F.log((1 + F.col("n_")) / (1 + F.col("df"))) + 1).alias("idf")), "word-weights")
    asked = docs.sparkSession.createDataFrame([(query,)], f"{text} string").select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("q"))
    asked = F.broadcast(asked).join(idf, "w").select("w", (F.col("q") * F.col("idf")).alias("qw")).collect()  # as many rows as the query has words
    norm, weight = math.sqrt(math.fsum(r["qw"] ** 2 for r in asked)), F.lit(0.0)
    for r in asked:
        weight = F.when(F.col("w") == r["w"], r["qw"] / norm).otherwise(weight)
    sizes = idf.groupBy("df").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("df")).limit(HELD_WORDS).collect()
    upto = itertools.accumulate(r["words"] for r in sizes)
    least = min((r["df"] for r, held in zip(sizes, upto) if held <= HELD_WORDS), default=None)
    often = F.lit(False) if least is None else F.col("df") >= least
    share = F.arrays_overlap("parts", F.array(*(F.lit(r["w"]) for r in asked)).cast("array<string>"))
    each = _counted(texts.where(share), key).select(key, F.explode("words").alias("x")).select(key, "x.w", "x.tf")
    near = each.join(F.broadcast(idf.where(often).select("w", "idf")), "w", "left")
    weighed = near.where("idf is not null").select(key, "w", "tf", "idf")
    if idf.where(~often).limit(1).count():
        far = near.where("idf is null").drop("idf").join(idf.where(~often).select("w", "idf"), "w")
        weighed = weighed.unionByName(far.select(key, "w", "tf", "idf"))
    x = F.col("tf") * F.col("idf")
    return weighed.groupBy(key).agg((F.sum(x * weight) / F.sqrt(F.sum(x**2))).alias("cosine")).where("cosine > 0")
