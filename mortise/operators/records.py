"""Keywords, scored matches, merged records and ordered budgets."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def by_key(df: DataFrame, key: str, parts: Column, join: Callable[[Column], Column]) -> DataFrame:
    """key, parts: one row for each key (null is one), of rows whose parts are not null. Only if a key repeats are rows gathered: join makes one of its parts' array; else nothing but the keys is shuffled."""
    own = df.select(key, parts.alias("parts")).where("parts is not null")
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return own.groupBy(key).agg(join(F.collect_list("parts")).alias("parts")) if twice else own


def _phrases(text: str, stop: frozenset[str], longest: int, k: int) -> list[tuple[str, float]]:
    """Phrases of a text of words, blanks and bars with their scores; those that cannot be among the k best are left out."""
    counts, run = Counter(), []
    for w in (*text.split(" "), "|"):
        if w == "|" or w in stop:
            if 0 < len(run) <= longest:
                counts[tuple(run)] += 1
            run = []
        elif w:
            run.append(w)
    degree, often = Counter(), Counter()
    for ws, c in counts.items():
        for w in ws:
            degree[w] += c * len(ws)
            often[w] += c
    rate = {w: d / often[w] for w, d in degree.items()}
    scored = [(" ".join(ws), sum(rate[w] for w in ws)) for ws in counts]
    if len(scored) <= k:
        return scored
    last = heapq.nlargest(k, (s for _, s in scored))[-1] - 2e-6  # scores that are equal once rounded are ordered by phrase
    return [x for x in scored if x[1] >= last]


def rake(df: DataFrame, key: str, text: str, stop_words: tuple[str, ...], longest: int = 4, k: int = 30) -> DataFrame:
    """key, phrase, score, place: the k best phrases of each text by rapid keyword extraction.

    Phrases are runs of words between stop words and punctuation, of longest words at most. A word's degree is the number of words in
    the phrases it is in, over its frequency; a phrase scores the sum over its words. Ties go by phrase. Null and empty texts have none.
    A text's words are counted in the task that holds its row; the texts of a key that repeats count as one.
    """
    stop = frozenset(stop_words)
    texts = by_key(df.where(F.col(key).isNotNull()), key, F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N} ]+", " | "), lambda c: F.array_join(c, " | "))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_phrases(t, stop, longest, k) for t in batch.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            found = pa.StructArray.from_arrays([pa.array([p for x in each for p, _ in x], pa.string()), pa.array([s for x in each for _, s in x], pa.float64())], names=["phrase", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, found)], names=[key, "found"])

    scored = texts.mapInArrow(of, f"`{key}` {dict(df.dtypes)[key]}, found array<struct<phrase: string, score: double>>")
    order = F.transform("found", lambda x: F.struct((-F.round(x["score"], 6)).alias("low"), x["phrase"].alias("phrase")))
    best = scored.select(key, F.posexplode(F.slice(F.array_sort(order), 1, k)).alias("at", "x"))
    return best.select(key, F.col("x.phrase").alias("phrase"), (-F.col("x.low")).alias("score"), (F.col("at") + 1).alias("place"))


def merge_records(df: DataFrame, keys: list[str], fields: list[str], strength: str, order: str) -> DataFrame:
    """One row a key: of each field the first non-null value of the greatest strength, the number of rows, the greatest strength. Nothing is listed."""
    by = F.struct(F.col(strength), -F.col(order))
    best = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), by)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*best, F.count(F.lit(1)).alias("n"), F.max(strength).alias("strength"))


def content_distinct(df: DataFrame, texts: list[str], numbers: list[str], order: list[Column]) -> DataFrame:
    """The first row of each content: texts lower-cased with single blanks, numbers at 6 decimals, nulls equal."""
    shown = [F.coalesce(F.lower(F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))), F.lit("")) for t in texts] + [F.coalesce(F.format_number(n, 6), F.lit("")) for n in numbers]
    rows = df.withColumn("c_", F.sha2(F.concat_ws("\x1f", *shown), 256))
    return rows.withColumn("k_", F.row_number().over(Window.partitionBy("c_").orderBy(*order))).where("k_ = 1").drop("k_", "c_")


def unique_ids(df: DataFrame, key: str, order: list[Column], suffix: str = "_batch_") -> DataFrame:
    """df with unique_id: the key as text, with a numbered suffix from the second row of a key on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("unique_id", F.when(n > 1, F.concat(F.col(key).cast("string"), F.lit(suffix), F.lpad((n - 1).cast("string"), 5, "0"))).otherwise(F.col(key).cast("string")))


def greedy_budget(df: DataFrame, key: str, item: str, size: str, order: str, budget: int) -> DataFrame:
    """key, item, used: items of each key taken in order while they fit; what does not fit is skipped and smaller ones may follow.

    A taken item uses a part of the budget, so the fold keeps the running sum; a key's items come to one
    array of (order, item, size). Nulls and negative sizes are left out.
    """
    rows = df.where(F.col(size) >= 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(size).cast("long").alias("s")))).alias("all_"))
    kind = f"struct<used:bigint,taken:array<struct<item:{df.schema[item].dataType.simpleString()},used:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind[len("struct<used:bigint,taken:") : -1]).alias("taken")).cast(kind)
    fits = lambda a, x: a["used"] + x["s"] <= budget
    take = lambda a, x: F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["taken"], F.array(F.struct(x["i"].alias("item"), (a["used"] + x["s"]).alias("used")))).alias("taken"))
    folded = F.aggregate("all_", start, lambda a, x: F.when(fits(a, x), take(a, x)).otherwise(a))
    return rows.select(key, F.explode(folded["taken"]).alias("t")).select(key, F.col("t.item").alias(item), F.col("t.used").alias("used"))


def quota_selection(df: DataFrame, group: str, item: str, score: str, mode: str, family: str, total: int, per_mode: int, per_family: int) -> DataFrame:
    """group, item, place: up to total items of each group by score (ties by item), at most per_mode of a mode and per_family of a family.

    An item that either cap refuses is passed over. No cap can admit more than the first per_mode items of a (mode, family) pair, so
    only those, found by a window, reach the fold.
    """
    pair = Window.partitionBy(group, mode, family).orderBy(F.col(score).desc(), item)
    rows = df.where(F.col(score).isNotNull()).withColumn("k_", F.row_number().over(pair)).where(F.col("k_") <= min(per_mode, per_family, total))
    rows = rows.select(group, item, F.col(score).alias("s_"), F.coalesce(F.col(mode).cast("string"), F.lit("")).alias("m_"), F.coalesce(F.col(family).cast("string"), F.lit("")).alias("f_"))

    best = F.array_sort(F.collect_list(F.struct(F.struct((-F.col("s_")).alias("low"), item).alias("o"), "m_", "f_")))
    none = F.array().cast(f"array<struct<item:{df.schema[item].dataType.simpleString()},m:string,f:string>>")

    def take(taken: Column, x: Column) -> Column:
        open_ = (F.size(taken) < total) & (F.size(F.filter(taken, lambda t: t["m"] == x["m_"])) < per_mode) & (F.size(F.filter(taken, lambda t: t["f"] == x["f_"])) < per_family)
        return F.when(open_, F.concat(taken, F.array(F.struct(x["o"][item].alias("item"), x["m_"].alias("m"), x["f_"].alias("f"))))).otherwise(taken)

    chosen = rows.groupBy(group).agg(F.aggregate(best, none, take).alias("taken"))
    return chosen.select(group, F.posexplode("taken").alias("at", "t")).select(group, F.col("t.item").alias(item), (F.col("at") + 1).cast("long").alias("place"))


def text_contains(df: DataFrame, key: str, text: str, names: DataFrame, name: str, other: str = "Others") -> DataFrame:
    """key, found: the names whose words stand in the text one after another, a row each; other where there is none.

    Texts become distinct runs of as many words as some name has, which are joined by equality, so nothing is compared pair by pair and no text is shuffled.
    """
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    book = names.select(F.col(name).alias("found"), words(F.col(name)).alias("w_")).where("size(w_) > 0").distinct()
    lengths = sorted(r[0] for r in book.select(F.size("w_")).distinct().collect())  # at most the longest name's length
    own = df.select(key, F.explode(F.array(words(F.col(text)))).alias("w_"))
    run = lambda n: F.when(F.size("w_") >= n, F.transform(F.sequence(F.lit(1), F.size("w_") - n + 1), lambda i: F.slice("w_", i, n))).otherwise(F.array().cast("array<array<string>>"))
    runs = own.select(key, F.explode(F.array_distinct(F.flatten(F.array(*map(run, lengths))))).alias("w_")) if lengths else own.where(F.lit(False)).select(key, "w_")
    hits = runs.join(book, "w_").select(key, "found").distinct()
    return df.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("found", F.lit(other)).alias("found"))


def acf(df: DataFrame, group: str, at: str, value: str, lags: int) -> DataFrame:
    """group, lag, acf: autocorrelations of each group's series, whose steps are consecutive whole numbers; joined by step, so gaps count as absent."""
    own = df.groupBy(group).agg(F.avg(value).alias("m_"), (F.var_pop(value) * F.count(value)).alias("v_"))
    x = df.join(own, group).select(group, at, (F.col(value) - F.col("m_")).alias("x_"), "v_")
    later = x.select(group, F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), at, F.col("x_").alias("y_"), "v_").withColumn(at, F.col(at) - F.col("lag"))
    return x.drop("v_").join(later, [group, at]).groupBy(group, F.col("lag").cast("long").alias("lag")).agg((F.sum(F.col("x_") * F.col("y_")) / F.nullif(F.first("v_"), F.lit(0.0))).alias("acf"))


def _fit_ar(y, p: int, d: int):  # noqa: ANN001, ANN202
    """Least-squares autoregression of order p on the d-th differences: coefficients (constant first) and AIC."""
    import numpy as np

    z = np.diff(y, d)
    n = len(z) - p
    x = np.column_stack([np.ones(n), *(z[p - k : len(z) - k] for k in range(1, p + 1))])
    beta = np.linalg.lstsq(x, z[p:], rcond=None)[0]
    mean_square = max(float(((z[p:] - x @ beta) ** 2).mean()), 1e-12)
    return beta, n * np.log(mean_square) + 2 * (p + 2)


def forecast(df: DataFrame, group: str, at: str, value: str, ahead: int = 5, orders: int = 5, differences: int = 1) -> DataFrame:
    """group, step (1..ahead), forecast, p: each group's series, in order of at, continued by the autoregression on differences with the lowest AIC per observation among orders 0..orders. Series are aggregates (one value a period), so a group's is short; those of under 4 * (differences + 1) values repeat their last value."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            y = frame.sort_values(at)[value].to_numpy(dtype=float)
            y = y[~np.isnan(y)]
            p, out = 0, [float(y[-1]) if len(y) else float("nan")] * ahead
            if len(y) >= 4 * (differences + 1):
                fits = {q: _fit_ar(y, q, differences) for q in range(orders + 1) if len(y) - differences - q >= 2 * (q + 2)}
                p = min(fits, key=lambda q: (fits[q][1] / (len(y) - differences - q), q))
                z, last = list(np.diff(y, differences)), [float(np.diff(y, k)[-1]) for k in range(differences)]
                out = []
                for _ in range(ahead):
                    step = float(fits[p][0][0] + sum(fits[p][0][k] * z[-k] for k in range(1, p + 1)))
                    z.append(step)
                    for k in range(differences - 1, -1, -1):
                        last[k] += step
                        step = last[k]
                    out.append(step)
            yield pd.DataFrame({group: [frame[group].iloc[0]] * ahead, "step": range(1, ahead + 1), "forecast": out, "p": p})

    schema = StructType([df.schema[group], StructField("step", LongType())]).add("forecast", "double").add("p", "long")
    return df.groupBy(group).applyInPandas(lambda frame: next(of(iter([frame]))), schema)
