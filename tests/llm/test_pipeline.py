"""run() of the pipeline, and the licence scan, against brute force."""

import itertools
import re

import numpy as np
import pytest

from mortise.llm import license_scan, quality_rules
from tests_llm_brute import contamination, line_components, roots, word_shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def corpus():
    r = np.random.default_rng(11)
    vocab = ["".join(r.choice(list("abcdefghijklm"), r.integers(3, 9))) for _ in range(900)]
    line = lambda: "the " + " ".join(r.choice(vocab, 24))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(40)]
    shared = line()
    for i in range(40, 52):  # near copies, each with a line that many have
        words = rows[i - 40][1].split(" ")
        words[i % 7 + 3] = "changed"
        rows.append((i, " ".join(words) + "\n" + shared))
    passage = line()
    rows += [(60 + i, "\n".join(line() for _ in range(2)) + "\n" + f"{passage} {line()}") for i in range(3)]
    rows += [(70, "short"), (71, "a b c " * 60), (72, None), (73, ""), (74, rows[0][1]), (74, rows[0][1]), (None, "\n".join(line() for _ in range(4)))]
    return rows, [(1, passage), (2, None), (3, "nothing of the kind is in there")]


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for i, v in enumerate(windows) if windows.count(v) > 1 for x in range(i, i + 3)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w) and bool({x.lower() for x in w} & set(quality_rules.STOP_WORDS))


def test_run(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [(i, t) for i, t in rows if good(t)]
    gone = line_components(sorted(set(want), key=lambda x: (x[0] is None, x[0])))
    want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in want]
    want = [(i, t) for i, t in want if t.strip()]
    known = [(i, t) for i, t in want if i is not None]
    sets = [word_shingles(t, 5) for _, t in known]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = roots(len(sets), links)
    copies = {known[k] for k, c in enumerate(up) if known[c][0] != known[k][0]}
    want = [x for x in want if x not in copies]
    hit = {x: contamination(x[1], items) for x in want}
    want = [x for x in want if not (hit[x][1] and 20 * hit[x][1] >= hit[x][0])]
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert len(want) < len(rows) - 10
    tokens = {}
    assert {(r.doc_id, r.text) for r in got} <= set(want)
    drawn = {}
    for r in got:
        assert r.n_tokens == len(r.text.split()) and r.copies >= 1 and r.n_chars == len(r.text)
        drawn[r.source] = drawn.get(r.source, 0) + r.n_tokens * r.copies
        tokens[r.source] = r.weight
    total = sum(len(t.split()) for _, t in want)
    for s, weight in tokens.items():
        assert weight * total - 130 <= drawn[s] <= weight * total + 1


def test_licences_against_brute_force(spark):
    r = np.random.default_rng(4)
    vocab = ["".join(r.choice(list("abcdefg"), r.integers(3, 8))) for _ in range(300)]
    words = lambda n: " ".join(r.choice(vocab, n))
    rows, names = [], sorted(license_scan.TEMPLATES)
    for i in range(120):
        t = license_scan.TEMPLATES[names[i % len(names)]].split()
        if i % 3 == 1:  # a few words lost
            del t[:: max(8, 16 - i % 8)]
        rows.append((i, f"{words(40)} {' '.join(t) if i % 4 else ''} {words(60)}"))
    rows += [(500, None), (501, ""), (None, license_scan.TEMPLATES["mit"])]

    def pairs(text):
        w = re.findall(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?", (text or "").lower())
        return list(zip(w, w[1:]))

    def brute(text):
        own, out = pairs(text), []
        for name, t in license_scan.TEMPLATES.items():
            want = set(pairs(t))
            reach = len(pairs(t)) + license_scan.WINDOW
            if any(100 * len(want & set(own[i : i + reach])) // len(want) >= license_scan.CONTAINMENT for i in range(max(1, len(own) - reach + 1))):
                out.append(name)
        return ",".join(sorted(out))

    for literals in (20_000, 3):
        license_scan.LITERALS = literals
        got = {r.doc_id: r.licenses for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        found = [set(got[i].split(",")) >= set(brute(t).split(",")) for i, t in rows if i is not None]
        assert np.mean(found) >= 0.99, [(got[i], brute(t)) for i, t in rows if i is not None and not set(got[i].split(",")) >= set(brute(t).split(","))][:3]
        assert got[500] == got[501] == got[None] == ""
    license_scan.LITERALS = 20_000
