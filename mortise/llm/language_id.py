"""Operator 12: language identification by rank-order profiles.

A text's code points are lower-cased one by one; letters stay, and every run of others is one blank, with one before the first word
and one after the last. Its n-grams are the substrings of one to three characters but the lone blank. A profile lists the
PLACES most frequent n-grams, most frequent first and equal counts in code-point order. A language's profile is counted over all its training
texts together, by a distributed sum; a document goes to the language whose profile has the smallest out-of-place distance: for
each n-gram of the document's profile the difference of its two places, or PLACES where the language's profile lacks it. Equal
distances go to the smaller language value.

Training reads text and lang of every row whose crc32(doc_id) mod 4 is not 2 (null ids are not read), whole texts and no sample. Score is
1 - distance / (PLACES x n-grams in the document's profile). Null texts and texts without a letter are `und` with score 0, and so is everything if nothing
was learned. Repeated ids and rows are judged row by row; an empty table gives an empty result; extra columns are not read. What reaches the driver is
PLACES n-grams for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PLACES = 300
#: Distinct (language, n-gram) pairs that a task sums up before it hands them on, and characters that are cut into n-grams at once.
HELD, PIECE = 1_000_000, 500_000
_BLANK = 32


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


@cache
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank. A lower case of several code points is not taken."""
    out = np.full(0x110000, _BLANK, dtype=np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def normal(text: str) -> np.ndarray:
    """The code points of a text as defined above; empty if it has no letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    points = np.concatenate((np.array([_BLANK], dtype=np.int32), points, np.array([_BLANK], dtype=np.int32)))
    keep = points != _BLANK
    keep[1:] |= keep[:-1]  # a blank stays only behind a letter
    keep[0] = True
    points = points[keep]
    return points if len(points) > 1 else points[:0]


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of one, two and three characters, packed in 21 bits a character, so that numbers are in code-point order."""
    points = points.astype(np.int64)
    a = points << 42
    two = a[:-1] | points[1:] << 21
    return a[points != _BLANK], two, two[:-1] | points[2:]


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and counts of one text; a long one is cut into pieces that overlap by two characters."""
    parts = []
    for at in range(0, max(1, len(points) - 2), PIECE):
        one, two, three = grams(points[at : at + PIECE + 2])
        if at + PIECE + 2 < len(points):  # the overlap's own belong to the next piece
            one, two = grams(points[at : at + PIECE])[0], two[:PIECE]
        parts.append(np.unique(np.concatenate((one, two, three)), return_counts=True))
    return parts[0] if len(parts) == 1 else summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def profile(points: np.ndarray, places: int) -> np.ndarray:
    keys, counts = counted(points)
    if len(keys) > places:  # those above the count of the last place, then as many equals as fit, in code-point order
        least = np.partition(counts, len(counts) - places)[len(counts) - places]
        above = counts > least
        equal = np.flatnonzero(counts == least)[: places - int(above.sum())]
        above[equal] = True
        keys, counts = keys[above], counts[above]
    return keys[np.argsort(-counts, kind="stable")]


def profiles(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """lang, gram, place (from 0) of each language, from all its rows of docs (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        points = size = 0

        def cut() -> None:
            nonlocal points, size
            for lang, some in waiting.items():
                held.setdefault(lang, []).append(joined(some))
                size += len(held[lang][-1][0])
            waiting.clear()
            points = 0

        def merge() -> None:
            nonlocal size
            for lang, v in held.items():
                held[lang] = [summed(np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v]))]
            size = sum(len(v[0][0]) for v in held.values())

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for lang, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v[0][0]), pa.string()), pa.array(v[0][0]), pa.array(v[0][1])], names=["lang", "gram", "n"])
            held.clear()
            size = 0

        for b in batches:
            texts, langs = b.column(0), b.column(1).to_pylist()
            for k, lang in enumerate(langs):
                own = normal(texts[k].as_py() or "")
                if len(own) > PIECE:
                    held.setdefault(lang, []).append(counted(own))
                    size += len(held[lang][-1][0])
                elif len(own):
                    waiting.setdefault(lang, []).append(own)
                    points += len(own)
                if points >= PIECE:
                    cut()
                if size >= HELD:
                    merge()
                    if size >= HELD // 2:
                        yield from rows()
        cut()
        merge()
        yield from rows()

    counts = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # limited before the shuffle
    return counts.withColumn("place", place - 1).where(F.col("place") < places).select("lang", "gram", "place")


def joined(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and counts of several texts; those that span two texts are left out."""
    whole = np.concatenate(some)
    ends = np.cumsum([len(p) for p in some])[:-1]
    one, two, three = grams(whole)
    in_two, in_three = np.ones(len(two), dtype=bool), np.ones(len(three), dtype=bool)
    in_two[ends - 1] = False
    in_three[ends - 1] = False
    in_three[ends - 2] = False
    return np.unique(np.concatenate((one, two[in_two], three[in_three])), return_counts=True)


def identify(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    learned = profiles(docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()), places).collect()  # places rows a language
    names = sorted({r["lang"] for r in learned})
    known = np.array(sorted({r["gram"] for r in learned}), dtype=np.int64)
    ranks = np.full((len(names), len(known) + 1), -1, dtype=np.int64)  # the last column: in no profile
    at, line = {g: k for k, g in enumerate(known.tolist())}, {n: k for k, n in enumerate(names)}
    for r in learned:
        ranks[line[r["lang"]], at[r["gram"]]] = r["place"]
    model = docs.sparkSession.sparkContext.broadcast((names, known, ranks))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, ranks = model.value
        for b in batches:
            texts, langs, scores = b.column(1), [], []
            for k in range(len(texts)):
                points = normal(texts[k].as_py() or "")
                if not len(points) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                own = profile(points, places)
                spot = np.searchsorted(known, own)
                spot[known[np.minimum(spot, len(known) - 1)] != own] = len(known)
                place = ranks[:, spot]
                distance = np.where(place < 0, places, np.abs(place - np.arange(len(own)))).sum(1)
                best = int(distance.argmin())
                langs.append(names[best])
                scores.append(1 - int(distance[best]) / (places * len(own)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")
    return judged.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
