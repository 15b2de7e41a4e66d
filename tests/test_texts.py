"""Keyword walks, matches with places, and JSON repair, each against a plain version."""

import json
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mortise.functions.matches import all_matches
from mortise.functions.repair import repair_json
from mortise.operators import keywords

DOCS = "id long, text string"
STOP = ("the", "and")


def plain_phrases(text, by_position, window=3, rounds=10, longest=3):
    words = [w if len(w) >= 3 and w not in STOP else None for w in re.findall(r"[^\W\d_]+", text.lower())]
    weight = defaultdict(float)
    for i, a in enumerate(words):
        for b in words[i + 1 : i + window]:
            if a and b and a != b:
                weight[a, b] += 1
                weight[b, a] += 1
    pull = defaultdict(float)
    for i, w in enumerate(words):
        if w:
            pull[w] += 1 / (i + 1) if by_position else 0
    bias = {w: (v if by_position else 1) / (sum(pull.values()) if by_position else len(pull)) for w, v in pull.items()}
    out = Counter()
    for (a, _), v in weight.items():
        out[a] += v
    rank = dict(bias)
    for _ in range(rounds):
        new = {w: 0.15 * b for w, b in bias.items()}
        for (a, b), v in weight.items():
            new[b] += 0.85 * v / out[a] * rank[a]
        rank = new
    phrases, run = set(), []
    for w in [*words, None]:
        if w:
            run.append(w)
        else:
            phrases |= {tuple(run[k : k + longest]) for k in range(0, len(run), longest)}
            run = []
    return {" ".join(p): sum(rank[w] for w in p) for p in phrases}


@pytest.mark.parametrize("by_position", [True, False])
def test_phrases_equal_plain(spark, by_position):
    r = random.Random(3)
    vocabulary = ["the", "and", "of", "graph", "word", "rank", "élan", "walk", "edge", "node", "x1y", "topic"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 30, 200])))) for i in range(20)] + [(50, None), (51, ""), (52, "the and 12"), (53, "Lonely")]
    got = keywords.rank_phrases(spark.createDataFrame(rows, DOCS), "id", "text", STOP, by_position, count=1000).collect()
    assert {(x.id, x.phrase): x.score for x in got} == {(i, p): pytest.approx(s, abs=2e-9) for i, t in rows for p, s in plain_phrases(t or "", by_position).items()}
    for i in {x.id for x in got}:
        own = sorted((x for x in got if x.id == i), key=lambda x: x.place)
        assert [x.place for x in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: (-x.score, x.phrase))


def test_topics_gather_phrases_by_head(spark):
    text = "graph walker and random walking and edge and random walking and node and graph walker and edge"
    got = keywords.rank_topics(spark.createDataFrame([(1, text), (2, None)], DOCS), "id", "text", STOP, stem=4).orderBy("place").collect()
    assert {r.phrase for r in got} == {"graph walker", "edge", "node"} and got[0].phrase == "graph walker"  # walker and walking are one topic
    assert sum(r.score for r in got) == pytest.approx(1, abs=1e-6)


def test_topics_are_linked_over_any_distance(spark, monkeypatch):
    r = random.Random(9)
    heads = [f"{a}{b}{c}word" for a in "abcd" for b in "efg" for c in "hij"]
    rows = [(i, " and ".join(r.choice(heads) for _ in range(n))) for i, n in enumerate((1, 2, 40, 70))] + [(9, " and ".join([heads[0]] * 30 + [heads[1]])), (10, " and ".join([heads[2]] * 5))]
    want = {}
    for i, text in rows:
        words = text.split(" and ")
        weight = {(a, b): sum(1 / abs(2 * j - 2 * k) for j, x in enumerate(words) for k, y in enumerate(words) if x == a and y == b) for a in words for b in words if a != b}
        rank = dict.fromkeys(words, 1 / len(set(words)))
        for _ in range(10):
            rank = {a: 0.15 / len(rank) + sum(0.85 * w * rank[b] / sum(v for (x, _), v in weight.items() if x == b) for (b, c), w in weight.items() if c == a) for a in rank}
        want |= {(i, a): pytest.approx(v, abs=2e-9) for a, v in rank.items()}
    docs = spark.createDataFrame(rows, DOCS)
    got = keywords.rank_topics(docs, "id", "text", STOP, count=1000).collect()
    assert {(x.id, x.phrase): x.score for x in got} == want
    lists = pa.array([[w for word in text.split(" and ") for w in (word, None)] for _, text in rows])
    whole = keywords.topic_ranks(keywords.Places(lists, 3), 5, 10)
    monkeypatch.setattr(keywords, "MOST_SUMS", 50)  # sums are made anew each round
    for block in (1, 100):
        some = keywords.topic_ranks(keywords.Places(lists, 3), 5, 10, block)
        assert some[0].tolist() == whole[0].tolist() and some[1] == pytest.approx(whole[1], abs=1e-13)


def test_walks_shuffle_only_the_best_phrases(spark):
    docs = spark.createDataFrame([(i, "graph walk and edge node walk") for i in range(30)], DOCS)
    for got in (keywords.rank_phrases(docs, "id", "text", STOP), keywords.rank_topics(docs, "id", "text", STOP)):
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1


def test_pieces_of_a_batch_equal_each_document_alone():
    lists = pa.array([["graph", None, "walk", "edge"], [], [None], ["edge", "edge", "graph", "walk", "node"], ["walk"]])
    for rank in (lambda p: keywords.phrase_ranks(p, True, 3, 10), lambda p: keywords.topic_ranks(p, 5, 10, 10)):
        def named(some):
            p = keywords.Places(some, 3)
            first, score = rank(p)
            return [(p.doc[p.parts[k, 0]], n, pytest.approx(s)) for k, n, s in sorted(zip(first, p.names(first).to_pylist(), score.tolist()))]

        alone = [(i, n, s) for i in (0, 3, 4) for _, n, s in named(lists.slice(i, 1))]
        assert named(lists) == alone and [(i + 2, n, s) for i, n, s in named(lists.slice(2))] == [x for x in alone if x[0] > 1]


def test_matches_have_places_and_windows(spark):
    rows = [(1, "ab12cd345"), (2, "\U0001f600é7\U0001f600"), (3, None), (4, "none"), (5, ""), (6, "9" * 5)]
    got = sorted(tuple(r) for r in all_matches(spark.createDataFrame(rows, DOCS), "text", r"\d+", 2, 1).drop("text").collect())
    assert got == [(1, 0, 2, 4, "12", 0, "ab12c"), (1, 1, 6, 9, "345", 4, "cd345"), (2, 0, 2, 3, "7", 0, "\U0001f600é7\U0001f600"), (6, 0, 0, 5, "99999", 0, "99999")]
    over = all_matches(spark.createDataFrame([(1, "aaab"), (2, "banana")], DOCS), "text", "a.a|aa", overlapping=True).collect()
    assert sorted((r.id, r.start, r.match) for r in over) == [(1, 0, "aaa"), (1, 1, "aa"), (2, 1, "ana"), (2, 3, "ana")]
    empty = all_matches(spark.createDataFrame([(1, "ba")], DOCS), "text", "a*").collect()
    assert [(r.start, r.end) for r in sorted(empty, key=lambda r: r.ordinal)] == [(0, 0), (1, 2), (2, 2)]
    assert all_matches(spark.createDataFrame([], DOCS), "text", "a").collect() == []


def repaired(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).select("id", repair_json(F.col("text")).alias("j"))
    return [(r.j.state, r.j.json if r.j.json is None else json.loads(r.j.json)) for r in sorted(df.collect(), key=lambda r: r.id)]


def plain_first(text):
    """The first balanced value from the first bracket on, by counting outside strings."""
    at = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=None)
    depth, quoted, escaped = 0, False, False
    for k, c in enumerate(text[at:] if at is not None else ""):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[at : at + k + 1]
    return None


def test_repair_of_known_damage(spark):
    value = {"a": [1, 2.5, {"b": 'quote " brace } \\ comma ,] é\U0001f600'}], "c": None, "d": True}
    text = json.dumps(value, ensure_ascii=False)
    cases = {
        f"```json\n{text}\n```": value, f"Sure:\n```\n{text}\n``` and {{more}}": value, f"x {text} y }}": value, text[:-1] + ",\n}": value, '[1, 2, ]': [1, 2], '{"a": [1, 2,], }': {"a": [1, 2]},
        '{"a": "x,]", }': {"a": "x,]"}, '{"a": "\\\\",}': {"a": "\\"},
    }
    assert repaired(spark, list(cases)) == [("whole", v) for v in cases.values()]
    cut = {
        '{"a": 1, "b": "he': {"a": 1, "b": "he"}, '{"a": 1, "b': {"a": 1, "b": None}, '{"a": 1, "b"': {"a": 1, "b": None}, '{"a": 1, "b":': {"a": 1, "b": None}, '{"a": 1,': {"a": 1}, '{"a": [1, {"x": tr': {"a": [1, {"x": None}]},
        '{"a": 12': {"a": 12}, '{"a": 1.': {"a": None}, '{"a": -': {"a": None}, '{"a": "x\\': {"a": "x"}, '{"a": "x\\u00e': {"a": "x"}, "{": {}, "[[": [[]], '```json\n{"a": [true': {"a": [True]}, '["a", "b"': ["a", "b"], '[1, "': [1, ""],
    }
    assert repaired(spark, list(cut)) == [("completed", v) for v in cut.values()]
    assert repaired(spark, [None, "", "no brackets", "{nonsense}", "}{"]) == [("none", None)] * 4 + [("completed", {})]


def test_repair_equals_a_balanced_scan_on_random_texts(spark):
    r = random.Random(5)

    def some(depth):
        kind = r.random()
        if depth > 3 or kind < 0.4:
            return r.choice([1, -2.5e3, None, True, "", 'a"}', "\\", "{[", "é,]", "line\nbreak"])
        return [some(depth + 1) for _ in range(r.randint(0, 3))] if kind < 0.7 else {r.choice(["k", 'q"', "x}", "é"]): some(depth + 1) for _ in range(r.randint(0, 3))}

    texts = [r.choice(["", "Answer: ", "```json\n"]) + json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) + r.choice(["", " }]", "\n```", " {x"]) for v in ([some(0)] if r.random() < 0.5 else {"r": some(0)} for _ in range(150))]
    assert repaired(spark, texts) == [("whole", json.loads(plain_first(t))) for t in texts]
    cuts = [t[: r.randint(0, len(t))] for t in texts]
    for t, (state, value) in zip(cuts, repaired(spark, cuts)):
        first = plain_first(t)
        assert (state == "whole" and value == json.loads(first)) if first else (state == ("completed" if re.search(r"[{\[]", t) else "none")), t


def test_repair_is_linear_in_long_strings(spark):
    long = json.dumps({"a": 'x"' * 60_000, "b": [1] * 2_000})
    assert repaired(spark, [long[:-1] + ",}", long[:-1]]) == [("whole", json.loads(long)), ("completed", json.loads(long))]
