"""Operator 8: quality rules, one table of thresholds compiled into one projection.

Words are runs of characters other than ASCII white space. Every measure is a built-in expression over
one row, so the query has no shuffle and no user function. A null text has no words and is rejected, as is an empty one; a very
long one is measured whole. Each row is judged by itself, whatever its doc_id, repeated rows too. An empty table gives an
empty result; extra columns of any name pass through keep_good().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+"
# Frequent function words of the four languages served.
STOP_WORDS = (
    "the of and to in a is that it for on with as was at by be this from or an are not "
    "le la les de des du et un une en que qui est pour dans "
    "der die das und ist nicht ein eine zu den von mit auf sich im "
    "el los las y que en un una es por con del para lo al se"
).split()
#: name, measure, lowest and highest value that pass (None: open). Measures are columns of measures().
THRESHOLDS = [
    ("too_few_words", "n_words", 50, None),
    ("repeated_windows", "repeat_percent", None, 50),
    ("mean_word_length", "mean_word", 1.5, 40),
    ("symbols", "symbol_ratio", None, 0.08),
    ("repeated_lines", "dup_line_ratio", None, 0.7),
    ("no_stop_words", "stop_words", 1, None),
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    Windows are hashed to 64 bits; a sort of the hashes tells whether any repeats. Only then are they sorted
    with their places, where a window equals a neighbour if it repeats.
    """
    n = F.size(words) - 2
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            twin = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed, of))

    return F.when(n < 2, F.lit(0)).otherwise(_let(hashes, covered))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures that THRESHOLDS names."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    stop = F.array(*map(F.lit, sorted(set(STOP_WORDS))))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    row = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_intersect(F.transform(w, F.lower), stop)).cast("long").alias("stop_words"),
        ),
    )
    base = docs.select("doc_id", F.explode(F.array(row)).alias("m")).select("doc_id", "m.*")  # the explode keeps the struct from being computed for each of its fields
    words_or_1 = F.greatest("n_words", F.lit(1))
    return base.select(
        "*",
        (100.0 * F.col("n_repeat_words") / words_or_1).alias("repeat_percent"),
        (F.col("word_chars") / words_or_1).alias("mean_word"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
    )


def failures(thresholds: list = THRESHOLDS) -> Column:
    """The names of the rules that a row of measures() breaks."""
    broken = []
    for name, measure, low, high in thresholds:
        bad = F.lit(False)
        bad = bad | (F.col(measure) < low) if low is not None else bad
        bad = bad | (F.col(measure) > high) if high is not None else bad
        broken.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge(docs: DataFrame, thresholds: list = THRESHOLDS) -> DataFrame:
    """A row for each document: doc_id, the measures, failed (names of broken rules), kept."""
    return measures(docs).withColumn("failed", failures(thresholds)).withColumn("kept", F.size("failed") == 0)


def keep_good(docs: DataFrame, thresholds: list = THRESHOLDS) -> DataFrame:
    """The rows of docs that break no rule, with the columns that they came with."""
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_m_row"))
    judged = measures_with(packed, thresholds)
    return judged.where("_m_ok").select("_m_row.*")


def measures_with(packed: DataFrame, thresholds: list) -> DataFrame:
    """packed (doc_id, text, _m_row) -> _m_row, _m_ok: the same projection, carrying the row."""
    text_only = packed.select(F.struct("_m_row").alias("doc_id"), "text")  # the row travels in the place of the id
    return measures(text_only).select(F.col("doc_id._m_row").alias("_m_row"), (F.size(failures(thresholds)) == 0).alias("_m_ok"))
