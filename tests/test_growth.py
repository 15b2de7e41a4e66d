"""Operators whose cost grew faster than their input, held against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from mortise.functions import parsing, support
from mortise.operators import linking, records, relations, texts
from mortise.registry import queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pair_scores_by_classes(spark, monkeypatch):
    r = np.random.default_rng(3)
    names = ["red ring", "ring red", "red red bolt", "", None, "blue bolt ring"]
    data = [(i, "b" if i % 5 else None, int(r.integers(3)), names[r.integers(6)], float(r.integers(2)) if r.integers(4) else None) for i in range(80)] + [(None, "b", 1, "red ring", 1.0), (7, "b", 1, "red ring", 1.0)]
    df = spark.createDataFrame(data, "k long, g string, h int, t string, p double").repartition(5)

    def score(x, y):
        s, t = (set(z[3].split(" ")) if z[3] is not None else None for z in (x, y))
        if (s is None) != (t is None):
            return None
        return round((0.75 * len(s & t) / min(len(s), len(t)) if s and t else 0.0) + (0.25 if x[4] == y[4] else 0.0), 4)

    want = sorted(((x[0], y[0], score(x, y)) for x, y in itertools.permutations([d for d in data if d[0] is not None and d[1] is not None], 2) if x[0] < y[0] and x[1:3] == y[1:3]), key=str)
    for size in (1_000, 6):
        monkeypatch.setattr(linking, "PAIR_ROWS", size, raising=False)
        got = linking.pair_scores(df, "k", ["g", "h"], "t", {"p": 0.25}, 0.75)
        assert rows(got) == want
    copies = spark.range(600).selectExpr("id as k", "'b' as g", "1 as h", "'red ring' as t", "1.0D as p")
    plan = linking.pair_scores(copies, "k", ["g", "h"], "t", {"p": 0.25}, 0.75)
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scored = next(i for i, line in enumerate(lines) if "array_intersect" in line)
    assert sum("Generate explode" in line for line in lines[:scored]) == 2  # rows come from a class pair that is scored already
    assert plan.count() == 600 * 599 // 2


def test_field_support_reads_a_text_once(spark):
    df = spark.createDataFrame([("Bridge  site", 'The "BRIDGE"‐site\t at 1.26 eV', 1.26), ("top", None, 2.0), (None, "12abc +x-y", 12.0), (" ", "top", None), ("top", "to-p \n top+", 1.0)], "t string, e string, v double")
    held, e = support.with_evidence(df, "e")
    of = lambda e: [support.field_status(["v"], ["t"], e), support.match_score([F.col("t"), F.lit("x-y")], e), support.text_supported(F.col("t"), e, 2)]
    got = held.select(*of(e)).collect()
    assert got == df.select(*of(F.col("e"))).collect()
    assert [r[0]["t"] for r in got] == ["supported", "supported", "missing", "weak_or_unsupported", "supported"]
    assert [r[1] for r in got] == [0.25, 0.0, 1.0, 0.0, 0.5]
    plan = queries()["field_support"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(parsing.NUMBER + ", 0) AS") + plan.count("regexp_extract_all(text") <= 2  # amount, and the numbers of the evidence


def test_best_match_margin_deals_rows(spark, monkeypatch):
    run = lambda: queries()["best_match_margin"](spark, "/root/testdata/sf0.001")
    whole = rows(run())
    monkeypatch.setattr(relations, "TASK_ROWS", 500, raising=False)
    few = run()
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert rows(few) == whole and few.rdd.getNumPartitions() == -(-lines // 500)


def shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count("Exchange")


def test_rake_in_place(spark):
    data = [("a", "Red ring, the red bolt of the blue ring ring."), ("b", None), ("c", ""), (None, "lone words"), ("d", "one two three four five, six"), ("e", " ".join(f"w{i:03}," for i in range(50)))]
    df = spark.createDataFrame(data, "k string, t string")
    got = records.rake(df, "k", "t", ("the", "of"))
    assert rows(got.select("k", "place", "phrase", "score")) == sorted(
        [("a", 1, "blue ring ring", 8.333333), ("a", 2, "red ring", 4.666667), ("a", 3, "red bolt", 4.0), ("d", 1, "six", 1.0), *(("e", i + 1, f"w{i:03}", 1.0) for i in range(30))], key=str)
    assert got.dtypes == [("k", "string"), ("phrase", "string"), ("score", "double"), ("place", "int")]
    assert shuffles(got) == 0
    more = df.union(spark.createDataFrame([("a", "green ring"), ("a", None)], "k string, t string"))  # the texts of a key count as one
    top = [r for r in rows(records.rake(more, "k", "t", ("the", "of")).select("k", "place", "phrase", "score")) if r[0] == "a"]
    assert top == [("a", 1, "blue ring ring", 8.0), ("a", 2, "green ring", 4.5), ("a", 3, "red ring", 4.5), ("a", 4, "red bolt", 4.0)]


def test_tfidf_shuffles_rare_words_only(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_tfidf(spark, monkeypatch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def check_tfidf(spark, monkeypatch):
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    data = [(i % 50 if i else None, " ".join(words[int(j)] for j in r.zipf(1.5, 12) if j < 40) if i % 11 else None) for i in range(60)]
    for some in (data[1:50], data):  # keys that do not repeat, and some that do
        df = spark.createDataFrame(some, "k long, t string")
        own = {}
        for k, t in some:
            own.setdefault(k, []).extend(w for w in (t or "").split(" ") if len(w) > 1)
        weight = {w: np.log((1 + len(some)) / (1 + sum(w in ws for ws in own.values()))) + 1 for w in words}
        asked = {w: weight[w] for w in ("w1", "w2", "w9") if any(w in ws for ws in own.values())}
        norm = np.sqrt(sum(x**2 for x in asked.values()))
        want = [(k, sum(ws.count(w) * weight[w] * x / norm for w, x in asked.items()) / np.sqrt(sum((ws.count(w) * weight[w]) ** 2 for w in set(ws)))) for k, ws in own.items() if set(ws) & set(asked)]
        for size in (200_000, 5):
            monkeypatch.setattr(texts, "HELD_WORDS", size, raising=False)
            found = texts.tfidf_cosine(df, "k", "t", "w1 w2 w9 other")
            got = rows(found.select("k", F.round("cosine", 6)))
            assert got == sorted(((k, round(float(x), 6)) for k, x in want), key=str)
            by_word = found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(w")
            assert (by_word == 0) == (size > 40)
