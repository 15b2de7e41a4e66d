"""Keyword extraction by random walks on word graphs, for all documents at once.

A document's graph holds its own words only, and a document is one row; so the walks of a batch of rows are one walk on the union of their graphs, in
arrays: numbered nodes, edges, and a fixed number of rounds of one sum by node. Spark cuts the words, deals the rows and chooses the best
phrases; no edge and no rank is shuffled, and what a task holds is a batch cut to MOST_WORDS words, or one longer document. Keys are unique. Topics are
all linked with one another, so each document's are walked by themselves.

There is no part-of-speech tagger here: a candidate word is one that is no stop word and has `least` letters or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

DAMPING = 0.85
#: Words whose graphs are walked together; a longer document is walked alone.
MOST_WORDS = 500_000
#: Pairs of a document's phrases whose distances are taken at a time, and sums of them that are held from round to round.
BLOCK_PAIRS, MOST_SUMS = 2**18, 2**24


def word_places(docs: DataFrame, key: str, text: str, stop: tuple[str, ...], least: int = 3) -> DataFrame:
    """key, words: a document's words, lower-cased, in order; null at words that are no candidates."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    good = lambda w: (F.char_length(w) >= least) & ~w.isin(*stop)
    return docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.transform(words, lambda w: F.when(good(w), w)).alias("words"))


def walk(a: np.ndarray, b: np.ndarray, weight: np.ndarray, bias: np.ndarray, rounds: int, damping: float = DAMPING) -> np.ndarray:
    """Each node's rank after rounds steps of a random walk on weighted edges between a and b, each given once, that restarts by bias.

    A node's rank is (1 - damping) * bias and damping times what its neighbours pass on in proportion to their edges; nodes without edges keep their
    share of the restarts. Ranks start at the bias.
    """
    a, b, weight = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((weight, weight))
    share = damping * weight / np.bincount(a, weight, len(bias))[a]
    rank = bias
    for _ in range(rounds):
        rank = (1 - damping) * bias + np.bincount(b, share * rank[a], len(bias))
    return rank


def summed(a: np.ndarray, b: np.ndarray, weight: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of different nodes once, in either direction, with the sum of its weights."""
    some = a != b
    pair, own = np.unique(np.minimum(a, b)[some] * count + np.maximum(a, b)[some], return_inverse=True)
    return pair // max(count, 1), pair % max(count, 1), np.bincount(own, weight[some], len(pair))


class Places:
    """The words of some documents in arrays: doc (row) and at (place in it) of each word, its code in dictionary (-1: no candidate), and its phrases.

    A phrase is a run of neighbouring candidate words, in pieces of at most `longest` from its start; parts are its words' places in these arrays (-1: none).
    """

    def __init__(self, lists: pa.ListArray, longest: int) -> None:
        self.doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        words = pc.list_flatten(lists).dictionary_encode()
        self.dictionary, self.code = words.dictionary, words.indices.fill_null(-1).to_numpy().astype(np.int64)
        every = np.arange(len(self.doc))
        opens = np.ones(len(self.doc), dtype=bool)
        opens[1:] = self.doc[1:] != self.doc[:-1]
        self.at = every - np.maximum.accumulate(np.where(opens, every, 0))
        good = self.code >= 0
        opens[1:] |= ~good[:-1]
        run = every - np.maximum.accumulate(np.where(opens | ~good, every, 0))
        first = every[good & (run % longest == 0)]
        self.parts = np.full((len(first), longest), -1)
        for j in range(longest):
            at = np.minimum(first + j, len(every) - 1)
            same = good[at] & (run[at] - run[first] == j) & (first + j < len(every)) & (at - run[at] == first - run[first])
            self.parts[same, j] = at[same]

    def names(self, some: np.ndarray) -> pa.Array:
        """The texts of some phrases."""
        parts = self.parts[some]
        columns = [self.dictionary.take(pa.array(self.code[parts[:, j]], mask=parts[:, j] < 0)) for j in range(parts.shape[1])]
        return pc.binary_join_element_wise(*columns, " ", null_handling="skip")


def phrase_ranks(p: Places, by_position: bool, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place in p.parts of each different phrase of a document, and the sum of its words' ranks; words that stand less than window places apart are linked by how often they do."""
    good = p.code >= 0
    keys, own = np.unique(p.doc[good] * len(p.dictionary) + p.code[good], return_inverse=True)
    count, node = len(keys), np.full(len(p.code), -1)
    node[good] = own
    pull = np.bincount(own, 1.0 / (p.at[good] + 1), count) if by_position else np.ones(count)
    of = keys // max(len(p.dictionary), 1)
    near = [(node[:-d][m], node[d:][m]) for d in range(1, window) for m in [(p.doc[:-d] == p.doc[d:]) & good[:-d] & good[d:]]]
    a, b = (np.concatenate([pair[k] for pair in near]) for k in (0, 1))
    rank = walk(*summed(a, b, np.ones(len(a)), count), pull / np.bincount(of, pull)[of], rounds)
    label, total = np.zeros(len(p.parts), dtype=np.int64), np.zeros(len(p.parts))
    for part in p.parts.T:
        label = np.unique(label * (count + 1) + np.where(part < 0, 0, node[part] + 1), return_inverse=True)[1]
        total += np.where(part < 0, 0.0, rank[node[part]])
    first = np.unique(label, return_index=True)[1]
    return first, total[first]


def nearness(starts: np.ndarray, at: np.ndarray, block: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """first, end, part: for topics first to end - 1, the sum of 1 / distance of their phrases to each phrase of another topic, in about `block` pairs at a time.

    at: the places of one document's phrases, topic by topic; starts: where each topic begins. A topic may come in several parts, which add up.
    """
    ends = np.append(starts[1:], len(at))
    rows = max(1, block // len(at))
    for low in range(0, len(at), rows):
        high = min(low + rows, len(at))
        first, end = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high, "left"))
        gap = np.abs(at[low:high, None] - at)
        for s, e in zip(starts[first:end], ends[first:end]):
            gap[max(s, low) - low : min(e, high) - low, s:e] = np.inf
        yield first, end, np.add.reduceat(1.0 / gap, np.maximum(starts[first:end], low) - low, axis=0)


def topic_walk(node: np.ndarray, at: np.ndarray, rounds: int, block: int, damping: float = DAMPING) -> np.ndarray:
    """The ranks of one document's topics, as walk() gives them, if each pair of phrases of different topics is an edge of weight 1 / distance. node: the topic of each phrase, rising from 0.

    All pairs are summed, which grows with the square of the phrases of a document; sums of more than MOST_SUMS numbers are not held, but made again for each round.
    """
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    count, at = len(starts), at.astype(float)
    parts = lambda: nearness(starts, at, block)
    if count * len(at) <= MOST_SUMS:
        held = np.zeros((count, len(at)))
        for first, end, part in nearness(starts, at, block):
            held[first:end] += part
        parts = lambda: [(0, count, held)]

    def drawn(each: np.ndarray) -> np.ndarray:
        total = np.zeros(count)
        for first, end, part in parts():
            total[first:end] += part @ each
        return total

    links = drawn(np.ones(len(at)))
    share = np.divide(damping, links, out=np.zeros(count), where=links > 0)
    rank = bias = np.full(count, 1.0 / count)
    for _ in range(rounds):
        rank = (1 - damping) * bias + drawn((share * rank)[node])
    return rank


def topic_ranks(p: Places, stem: int, rounds: int, block: int = BLOCK_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The first place in p.parts of each topic of a document, and the topic's rank."""
    first, last = p.parts[:, 0], p.parts.max(1)
    stems = pc.utf8_slice_codeunits(p.dictionary, 0, stem).dictionary_encode()
    doc = p.doc[first]
    _, at, node = np.unique(doc * len(stems.dictionary) + stems.indices.to_numpy().astype(np.int64)[p.code[last]], return_index=True, return_inverse=True)
    order = np.argsort(node, kind="stable")  # topic by topic, and so document by document
    node, place, opens = node[order], p.at[first[order]], np.flatnonzero(np.diff(doc[order], prepend=-1))
    each = [topic_walk(node[s:e] - node[s], place[s:e], rounds, block) for s, e in zip(opens, np.append(opens[1:], len(order)))]
    return at, np.concatenate(each)


def ranked(places: DataFrame, key: str, longest: int, rank: Callable[[Places], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """key, phrase, rank: rank() of the documents' words, in pieces of at most MOST_WORDS words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())
            start = 0
            while start < batch.num_rows:
                upto = (ends[start - 1] if start else 0) + MOST_WORDS
                end = max(start + 1, int(np.searchsorted(ends, upto, "right")))
                piece = batch.slice(start, end - start)
                start = end
                p = Places(piece.column(1), longest)
                if len(p.parts):
                    first, got = rank(p)
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(p.doc[p.parts[first, 0]])), p.names(first), pa.array(got)], names=[key, "phrase", "rank"])

    return places.mapInArrow(of, f"`{key}` {dict(places.dtypes)[key]}, phrase string, rank double")


def top(found: DataFrame, key: str, count: int) -> DataFrame:
    """key, phrase, score, place (from 1): the score is the rank to 9 digits (a hair above, so that exact halves go one way); equal scores in order of phrase."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    return found.select(key, "phrase", F.round(F.col("rank") + 1e-13, 9).alias("score")).withColumn("place", place).where(F.col("place") <= count)


def rank_phrases(docs: DataFrame, key: str, text: str, stop: tuple[str, ...], by_position: bool = True, window: int = 3, rounds: int = 10, longest: int = 3, count: int = 10) -> DataFrame:
    """The best phrases of every document: with by_position restarts favour early words (by the sum of 1 / place, from 1: PositionRank), else all words alike (SingleRank)."""
    places = word_places(docs, key, text, stop)
    return top(ranked(places, key, longest, lambda p: phrase_ranks(p, by_position, window, rounds)), key, count)


def rank_topics(docs: DataFrame, key: str, text: str, stop: tuple[str, ...], stem: int = 5, rounds: int = 10, longest: int = 3, count: int = 10) -> DataFrame:
    """key, phrase, score, place: TopicRank with topics by head word.

    A topic is all phrases of a document whose last words share their first `stem` letters. Two topics are linked by the sum of 1 / distance
    over all pairs of their phrases. The walk ranks topics, and a topic is named by its first phrase.
    """
    places = word_places(docs, key, text, stop)
    return top(ranked(places, key, longest, lambda p: topic_ranks(p, stem, rounds)), key, count)
