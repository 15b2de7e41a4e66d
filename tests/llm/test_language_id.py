"""Language identification against a plain version, and its edges."""

import random
import zlib
from collections import Counter

import numpy as np

from mortise.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def plain_grams(text):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    words = "".join(c if c.isalpha() else " " for c in low).split()
    s = f" {' '.join(words)} " if words else ""
    return Counter(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k] != " ")


def top(counts, places):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:places]]


def plain(rows, places):
    by = {}
    for i, text, lang in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 and plain_grams(text):
            by.setdefault(lang, Counter()).update(plain_grams(text))
    known = {lang: {g: k for k, g in enumerate(top(c, places))} for lang, c in by.items()}
    out = []
    for i, text, _ in rows:
        own = top(plain_grams(text), places)
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not own or not known:
            out.append((i, held, "und", 0.0))
            continue
        d, lang = min((sum(abs(p[g] - k) if g in p else places for k, g in enumerate(own)), lang) for lang, p in known.items())
        out.append((i, held, lang, 1 - d / (places * len(own))))
    return sorted(out, key=str)


def got(spark, rows, places, parts=3):
    return sorted(map(tuple, language_id.identify(spark.createDataFrame(rows, SCHEMA).repartition(parts), places).collect()), key=str)


def test_equals_plain(spark):
    r = random.Random(1)
    letters = {"aa": "abcde éè", "bb": "abxyz ßü", "cc": "дежз 中文字", "dd": "\U0001d400\U00010428İΣ ab"}
    rows = [(i, "".join(r.choices(alphabet + "  .1\n", k=r.randint(0, 300))), lang) for i in range(200) for lang, alphabet in [r.choice(list(letters.items()))]]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 .,-", "aa"), (503, "abc", None), (None, "abx", "aa"), (504, "a", "bb"), (505, "zzz " * 50, "bb"), (505, "zzz " * 50, "bb"), (505, "qqq", None)]
    for places in (300, 20, 5):
        assert got(spark, rows, places) == plain(rows, places)


def test_long_texts_and_merges(spark, monkeypatch):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(50)]
    long = " ".join(r.choices(words, k=3000))
    points = language_id.normal(long)
    want = sorted(plain_grams(long).items())
    for piece in (1, 2, 3, 7, 1000, 10**6):
        monkeypatch.setattr(language_id, "PIECE", piece)
        keys, counts = language_id.counted(points)
        named = ["".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s & 0x1FFFFF) for k in keys.tolist()]
        assert list(zip(named, counts.tolist())) == want
    many = [language_id.normal(" ".join(r.choices(words, k=r.randint(1, 5)))) for _ in range(40)]
    keys, counts = language_id.joined(many)
    total = Counter()
    for p in many:
        for k, n in zip(*(x.tolist() for x in language_id.counted(p))):
            total[k] += n
    assert dict(zip(keys.tolist(), counts.tolist())) == total
    assert language_id.summed(np.array([3, 1, 3]), np.array([1, 2, 5]))[1].tolist() == [2, 6]


def test_edges(spark):
    assert got(spark, [], 300) == []
    assert got(spark, [(1, "some text", None), (2, None, None)], 300) == [(1, False, "und", 0.0), (2, False, "und", 0.0)]
    extra = spark.createDataFrame([(1, "abc", "xx", 3.0, "n")], "doc_id long, text string, lang string, score double, lang_pred string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(extra).collect()] == [("xx", 1.0)]
    huge = [(1, "ab " * 700_000, "xx"), (3, "cd " * 10, "yy"), (2, "ab ab", None)]
    assert [x[2] for x in got(spark, huge, 300)] == ["xx", "xx", "yy"]


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(df).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.99 * len(rows)
