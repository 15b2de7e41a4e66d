"""Ranked search against a plain version, in many bundles and blocks, and its edges."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from mortise.llm import search

DOCS, ITEMS = "doc_id long, text string, source string", "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, ranks):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 50 + (50 * b.total() * n) // length
            score = sum(w[t] * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:ranks])]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    return sorted(map(tuple, search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2), **more).collect()), key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "naïve", "中文"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 40, 200]))), "s") for i in range(n)]
    docs += [(1000 + k, docs[7][1], "s") for k in range(30)]  # ties
    items = [(k, " ".join(r.choices(vocabulary, weights if k % 2 else None, k=r.choice([1, 3, 20])))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize(("seed", "bundle", "block", "ranks"), [(0, 256, 200_000, 50), (1, 4, 150, 50), (2, 7, 400, 5), (3, 1, 5_000, 1)])
def test_equals_plain(spark, seed, bundle, block, ranks):
    docs, items = corpus(seed)
    assert got(spark, docs, items, bundle=bundle, block=block, ranks=ranks) == plain(docs, items, ranks)


def test_bounds_drop_accumulators_but_no_result(spark, monkeypatch):
    """Owners that part this corpus evenly, so that floors are reached before the last of them."""
    monkeypatch.setattr(search, "OWNERS", (0.03, 0.1, 0.3))
    docs, items = corpus(5, 600)
    assert got(spark, docs, items, bundle=8, block=700, ranks=3) == plain(docs, items, 3)


def test_an_owner_drops_only_what_is_below_the_floor():
    stage = search.owner_stage(2)
    left = pa.table({"bundle": [0], "block": [0], "item": [1], "terms": [[7, 8]], "keys": [[1, 2]], "ids": [[11, 12]], "scores": [[50, 90]], "tops": [[90, 50]], "floor": [100], "due": [99], "rest": [10]})
    right = pa.table({"term": [7, 7, 7, 9], "key": [1, 2, 3, 2], "id": pa.array([11, 12, None, 12], pa.int64()), "gain": [39, 0, 99, 1000]})
    row = stage(left, right).to_pylist()[0]
    assert (row["keys"], row["ids"], row["scores"], row["tops"]) == ([2], [12], [90], [90])  # 1 has 89 + 10 < 100; 3 may not begin; 9 is not asked for
    row = stage(left.set_column(8, "floor", pa.array([99])), right).to_pylist()[0]
    assert dict(zip(row["ids"], row["scores"])) == {11: 89, 12: 90, search._NO_ID: 99} and sorted(row["tops"]) == [90, 99]


def test_shuffled_when_the_vocabulary_is_large(spark, monkeypatch):
    monkeypatch.setattr(search, "VOCABULARY_BYTES", 1)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 1)
    docs, items = corpus(6, 100)
    assert got(spark, docs, items, block=300) == plain(docs, items, 50)


def test_edges(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "?! --", "a"), (4, "Alpha beta", "a"), (4, "alpha", "a"), (None, "ALPHA", "a"), (None, "alpha beta", "a"), (5, "gamma " * 50_000, "a"), (6, "a@b", "a"), (7, "x" * 30_000, "a")]
    items = [(1, "alpha, BETA alpha"), (1, "beta"), (None, "gamma"), (2, None), (3, ""), (4, "nowhere"), (5, "x" * 30_000), (6, "b")]
    assert got(spark, docs, items) == plain(docs, items, 50)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None, "a")], items) == []
    named = spark.createDataFrame([(1, "alpha", 2, 3)], "doc_id int, text string, item_id int, score int")
    other = spark.createDataFrame([("q", "alpha", 1), ("q2", "beta", 1)], "item_id string, text string, doc_id int")
    w = math.floor(1000 * math.log(4 / 3))  # of a term that all of one document hold
    assert list(map(tuple, search.search(named, other).collect())) == [("q", 1, 1, w * (10**9 // (1000 + 20 * 100)))]
