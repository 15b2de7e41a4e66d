"""Line dedup: every shingle, every line of a bucket, every line of a text."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mortise.llm import graph, line_dedup
from mortise.session import materialise

DOCS = "doc_id long, text string"


def removed(spark, rows):
    report = line_dedup.line_report(spark.createDataFrame(rows, DOCS)).collect()
    return {(r.doc_id, int(k)) for r in report for k in r.removed.split(",") if k}


def test_every_shingle_counts(spark):
    line = "please subscribe to our newsletter today"
    rows = [(1, line + "."), (2, line + "!"), (3, line.upper() + "."), (4, "\t" + line + ".\r"), (5, line[:20] + " and nothing else here")]
    assert removed(spark, rows) == {(2, 0), (3, 0), (4, 0)}


def test_long_words_and_short_lines(spark):
    """What follows the beginning of a long word, number or address counts; short lines are compared like others."""
    rows = [(1, "https://www.example.com/paper-on-heat-transfer read more about it here\norder 1234567890123456 is on its way"), (2, "https://www.other-site.org/nothing-in-common read more about it here\norder 1234567898765432 is on its way"), (3, "accept all cookies.\nSubscribe now!\nYes"), (4, "Accept all cookies!\nsubscribe now!\nyes\nyea")]
    assert removed(spark, rows) == brute_force(rows) == {(4, 0), (4, 1), (4, 2)}


def test_repeated_and_null_ids(spark):
    """Rows of one id are documents of their own; equal rows keep or lose the same lines; rows without an id come last."""
    a, b = "the first of all the lines here", "quite another line, that is not like it"
    rows = [(1, b), (4, a), (4, b + " now"), (4, a), (None, a), (None, b + "\nkept: no other row has it"), (None, None), (-7, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS + ", m_key string, pos int, gone int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.m_key) for r in got.collect()) == sorted([(1, b, "x"), (4, a, "x"), (4, a, "x"), (0, "kept: no other row has it", "x"), (0, "", "x"), (-7, "", "x")])


def test_broadcast_bound_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "bounded_broadcast", lambda df: graph.bounded_broadcast(df, 1))
    lines = [(k, f"this is line number {k // 3} of the table, and there are more of them\nend {k}") for k in range(60)]
    assert {x for x in removed(spark, lines) if x[1] == 0} == {x for x in brute_force(lines) if x[1] == 0}


def brute_force(rows):
    """The lines that go: components of lines whose whole sets of 8-character shingles have Jaccard similarity 0.8 or more."""
    places = [(i, k, x.lower().strip()) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for _, _, x in places]
    up = list(range(len(sets)))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in places:
        before = list(up)
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    return {places[k][:2] for k, c in enumerate(up) if c != k}


def test_brute_force(spark):
    r = np.random.default_rng(7)
    vocab = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(400)]
    rows = [(i, "\n".join(" ".join(r.choice(vocab, int(r.integers(8, 40)))) for _ in range(3))) for i in range(60)]
    for i in range(60, 90):
        words = rows[i - 60][1].split(" ")
        for _ in range(i % 4):
            words[int(r.integers(len(words)))] = str(r.choice(vocab))
        rows.append((i, " ".join(words)))
    want, got = brute_force(rows), removed(spark, rows)
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 10


@pytest.mark.parametrize(("shared", "size", "block"), [(160, 150, 1000), (180, 400, 64), (190, 300, 5)])
def test_family_of_lines_that_do_not_link(spark, monkeypatch, shared, size, block):
    """Lines of one template, each linked to its own copy only: what shared a band is found, however many lines the bucket has."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    line = lambda n: "".join(r.choice(list("abcdefghij"), n))
    template = line(shared)
    own = [template + line(220 - shared) for _ in range(size)]
    rows = [(i, x) for i, x in enumerate([*own, *(x[:-12] + line(12) for x in own)])]
    want, got = brute_force(rows), removed(spark, rows)
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 100


def test_a_family_whose_lines_have_nothing_rare(spark, monkeypatch):
    """Every shingle occurs in many lines, so rare ones don't part them, and buckets are compared in blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdefghij"), 10)) for _ in range(14)]
    rows = [(i, " ".join(r.permutation(words)[:12])) for i in range(60)] + [(100 + i, " ".join(words[i % 14 :] + words[: i % 14])) for i in range(40)]
    want, got = brute_force(rows), removed(spark, rows)
    assert got <= want and len(got) >= 0.95 * len(want) > 10


def test_short_and_blank_lines(spark):
    chinese = " " * 20 + "这是一个短句子"
    rows = [(1, " " * 30 + "\nAccept all cookies\n---\n" + chinese), (2, "accept all cookies \n---\n" + chinese + "\nYes."), (3, " " * 30), (4, "Accept all cookies!\n" + "=" * 30), (5, "=" * 30 + "\nyes")]
    assert removed(spark, rows) == {(2, 0), (2, 2), (4, 0), (5, 0)}
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {1: rows[0][1], 2: "---\nYes.", 3: rows[2][1], 4: "=" * 30, 5: "yes"}


def test_texts_are_not_shuffled(spark):
    """The report needs a document's id and line numbers, so its text stays in the task that reads it."""
    r = np.random.default_rng(5)
    rows = [(i, "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(executors(False).apply(i).totalShuffleWrite() for i in range(executors(False).size()))

    before, bound = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [(r.n_lines, r.n_removed) for r in line_dedup.line_report(docs).collect()] == 60 * [(1, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert 0 < total() - before < 200_000  # 1,200,000 characters


def test_keys_beyond_one_broadcast_are_met_in_passes(spark, monkeypatch):
    r = np.random.default_rng(11)
    line = lambda: " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(12))
    rows = [(i, "\n".join(line() for _ in range(3))) for i in range(20)]
    rows += [(20 + i, x[:-3] + "xyz") for i, x in rows] + [(50, rows[0][1])]
    want = removed(spark, rows)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 7)
    for passes in (100, 1):  # then by a shuffle
        monkeypatch.setattr(graph, "PASSES", passes)
        assert removed(spark, rows) == want and len(want) > 20
    monkeypatch.setattr(graph, "PASSES", 8)
    keys = materialise(spark.range(0, 100, 4).withColumnRenamed("id", "k"), "keys")
    frames = graph.joined_in_passes(spark.range(200).withColumnRenamed("id", "k"), keys, "k")
    assert len(frames) == 4 and sorted(x.k for f in frames for x in f.collect()) == list(range(0, 100, 4))
    assert not any("SortMergeJoin" in f._jdf.queryExecution().executedPlan().toString() for f in frames)


def test_rare_shingles_shuffle_texts_not_sets(spark):
    r = np.random.default_rng(12)
    text = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 2_000))
    rows = [(i, text[i:] + text[:i]) for i in range(60)]
    texts = materialise(line_dedup._sized(spark.createDataFrame(rows, "place long, line string").coalesce(1)), "texts")
    lines = materialise(texts.select("place", *(F.lit(0).cast("long").alias(c) for c in line_dedup.SIG), F.col("place").alias("root")), "lines")
    executors = spark.sparkContext._jsc.sc().statusStore().executorList

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(executors(False).apply(i).totalShuffleWrite() for i in range(executors(False).size()))

    before = total()
    got = line_dedup._by_rare_shingles(texts, lines).groupBy("place").count().collect()
    assert len(got) == 60 and all(x["count"] == 1_993 // 5 + 1 for x in got)
    assert total() - before < 400_000  # 120,000 characters; sets are eight times that
