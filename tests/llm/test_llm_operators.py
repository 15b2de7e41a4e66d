"""The operators against brute force, and their edge cases."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mortise.llm import decontaminate, license_scan, line_dedup, mixing, ngram_join, pii, quality_net, quality_rules, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, token int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "p", 1) for i, t, s in rows], DOCS)


EDGES = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "one", "b"), (4, "one", "b"), (None, "no id but some words here", "b"), (5, "word " * 30_000, "b"), (6, "x" * 120_000, "b"), (7, "é\U0001f600 ü " * 20, "c")]


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact and near copies."""
    r = np.random.default_rng(7)
    vocab = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocab, n))
    rows = [(i, "\n".join(line(int(r.integers(8, 40))) for _ in range(int(r.integers(1, 6)))), f"s{i % 3}") for i in range(60)]
    for i in range(60, 90):
        words = rows[i - 60][1].split(" ")
        for _ in range(i % 4):
            words[int(r.integers(len(words)))] = str(r.choice(vocab))
        rows.append((i, " ".join(words), f"s{i % 3}"))
    return rows


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(n, links):
    up = list(range(n))
    for _ in range(n):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 2000), (2, 60, 3)])
def test_ngram_components(spark, corpus, n, percent, block):
    sets = [shingles(t, n) for _, t, _ in corpus]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(frame(spark, corpus), n, percent, block).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in enumerate(roots(len(sets), links))}
    assert len(links) > 10


def test_ngram_edges(spark):
    got = ngram_join.similar_documents(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {r.doc_id: r.component_id for r in got}[1] == 1
    assert ngram_join.keep_one(frame(spark, EDGES)).count() == len(EDGES)
    assert ngram_join.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("back", [False, True])
def test_ngram_repeated_ids(spark, back):
    """Rows that share an id keep their own links, in any order of rows."""
    x, y = ("".join(f"{c}{i} " for i in range(40)) for c in "xy")
    rows = [(4, x, "a"), (4, y, "a"), (9, y + "more", "a"), (12, x + "more", "a"), (20, "z " * 9, "a"), (20, "z " * 9, "a")]
    got = ngram_join.similar_documents(frame(spark, rows[::-1] if back else rows), 3, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (4, 4), (9, 4), (12, 4), (20, 20), (20, 20)]
    more = [*rows, (2, x, "a")]
    left = ngram_join.keep_one(frame(spark, more[::-1] if back else more), 3, 80).collect()
    assert sorted((r.doc_id, r.text[0]) for r in left) == [(2, "x"), (4, "y"), (20, "z"), (20, "z")]


def test_connect_agrees_with_pairs():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate((r.choice(base, 280, replace=False), r.integers(0, 2**63, int(r.integers(0, 40)), dtype=np.uint64)))) for _ in range(60)]
    sets += [np.unique(r.integers(0, 2**63, int(r.integers(1, 400)), dtype=np.uint64)) for _ in range(60)]
    links = [(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert ngram_join.connect(sets, 85).tolist() == roots(120, links)
    marked = ngram_join.promising([ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 85)
    assert all(marked[a] and marked[b] for a, b in links)


def test_line_dedup(spark, corpus):
    """Texts hold what the report leaves; test_line_dedup.py holds the report against brute force."""
    got = {(r.doc_id, int(k)) for r in line_dedup.line_report(frame(spark, corpus)).collect() for k in r.removed.split(",") if k}
    assert len(got) > 10
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, corpus)).collect()}
    for i, t, _ in corpus:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
        assert kept.get(i, "") == (left if left.strip() else kept.get(i, ""))


def test_line_dedup_edges(spark):
    report = line_dedup.line_report(frame(spark, [*EDGES, (8, "a line that is long enough to take part\n" * 3, "b")])).collect()
    assert {r.doc_id: r.removed for r in report}[8] == "1,2"
    out = line_dedup.dedup_lines(frame(spark, EDGES))
    assert out.columns == DOCS.replace(",", "").split()[::2] and out.count() == len(EDGES)
    assert line_dedup.line_report(frame(spark, [])).count() == 0
    assert line_dedup.line_report(frame(spark, [(2**40, "a line that is long enough to take part", "b"), (-1, "a line that is long enough to take part", "b")])).where("n_removed = 1").first().doc_id == 2**40


def test_license_scan(spark):
    rows = [(10, "Some words. " * 9 + "Released under the MIT License." + " more words" * 20, "a"), (11, "Licensed under the Apache License, Version 2.0.", "a"), (12, "the mit and the license of it are under debate", "a")]
    got = {r.doc_id: r.licenses for r in license_scan.license_report(frame(spark, EDGES + rows)).collect()}
    assert (got[10], got[11], got[12], got[5]) == ("mit", "apache-2.0", "", "")
    assert license_scan.license_report(frame(spark, [])).count() == 0


def test_urls(spark):
    urls = ["http://A.example.com/en/x?q", "https://www.example.com/en/", "http://x.net/es/a", "http://x.net/fr", None, "no scheme", "http://com/", "http://evilexample.com/en/", "ftp://example.com?x://y/", "http://x.net/es/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == ("a.example.com", "example.com/en/", "block") and got[1][1:] == ("www.example.com/en/", "allow") and got[2][1:] == ("net/es/", "block")
    assert got[3] == ("x.net", None, "allow") and got[4] == ("", None, "allow") and got[5] == ("", None, "allow") and got[6][1] == "com/" and got[7][1] == "com/" and got[8] == ("example.com", None, "allow")
    assert len(got) == 10 and url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_pii(spark):
    texts = ["mail a.b@c.de, d@e.f_g@h.ij or x@y", "ip 1.2.3.4.5 and 300.1.1.1 and 10.0.0.255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 é 1.2.3.4", "call +1 (741) 555-3069 or +12", "é" * 50 + "a@b.cc", "1 " * 9000]
    got = {r.doc_id: r for r in pii.digest(pii.find(frame(spark, EDGES + [(20 + i, t, "a") for i, t in enumerate(texts)]))).collect()}
    assert [(got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) for k in range(20, 26)] == [(3, 0, 0, 0), (0, 2, 0, 0), (0, 1, 1, 0), (0, 0, 0, 1), (1, 0, 0, 0), (0, 0, 0, 0)]
    assert got[24].spans == "email:50:56" and got[24].base_sha256 == hashlib.sha256(b"email:50:56").hexdigest()
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(frame(spark, [])).count() == 0


def test_quality_rules(spark):
    rows = [(30, "the " + " ".join(f"w{i}" for i in range(60)), "a"), (31, "a b c " * 40, "a"), (32, "the x\nthe x\n\n \n" + " ".join(f"w{i}" for i in range(60)) + " # $", "a")]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, EDGES + rows)).collect()}
    assert got[30].kept and not got[31].kept and got[31].n_repeat_words == 120 and got[32].n_dup_lines == 1 and got[32].n_symbols == 2
    assert not got[1].kept and got[1].n_words == 0 and got[7].word_chars == 60
    out = quality_rules.keep_good(frame(spark, EDGES + rows))
    assert sorted(r.doc_id for r in out.collect()) == [30, 32] and out.columns == DOCS.replace(",", "").split()[::2]


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, found = words(text), set(), set()
    for item_id, t in items:
        w = words(t)
        for win in [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []:
            for i in range(len(d) - len(win) + 1):
                if d[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item_id))
    return len(d), len(hit), sorted(found)


def test_decontaminate(spark, corpus, monkeypatch):
    items = [(1, " ".join(corpus[0][1].split()[:15])), (2, corpus[1][1]), (10, "ünï-codÉ, x"), (3, None), (4, ""), (5, corpus[0][1].split()[0])]
    rows = [*corpus, (200, "so ünï... CODÉ x!", "a"), *((i + 300, t, s) for i, t, s in EDGES[:4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 100):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(frame(spark, rows), bench).collect()}
        assert got == {i: brute_contamination(t, items) for i, t, _ in rows}
    span = {r.doc_id: [tuple(x) for x in r.spans] for r in decontaminate.contamination(frame(spark, rows), bench).collect()}[200]
    assert span == [(3, 16)]
    assert decontaminate.keep_clean(frame(spark, rows), bench).where("doc_id in (0, 200)").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0 and decontaminate.contamination(frame(spark, rows), bench.where("false")).where("n_hit > 0").count() == 0


def test_mixing(spark, corpus):
    rows = [(i, t, "big" if i < 70 else f"s{i % 2}") for i, t, _ in corpus] + [(i + 300, t, s) for i, t, s in EDGES[:4]]
    for block in (4000, 5):
        out = mixing.mix(frame(spark, rows), max_repeats=1.5, block=block).collect()
        tokens = {}
        for _, t, s in rows:
            tokens[s] = tokens.get(s, 0) + max(1, len((t or "").split()))
        for s, n in tokens.items():
            drawn = sum(r.n_tokens * r.copies for r in out if r.source == s)
            weight = next(r.weight for r in out if r.source == s)
            longest = max(max(1, len((t or "").split())) for _, t, x in rows if x == s)
            quota = weight * sum(tokens.values())
            assert quota <= 1.5 * n * 1.001 + 1 and quota - longest - 1 <= drawn <= quota + 1
    a = mixing.exponent(spark.createDataFrame([(1000,), (10,)], "tokens long"), 1010.0, 1.0)
    assert a == pytest.approx(1.0)
    entropy = mixing.exponent(spark.createDataFrame([(1000,), (10,)], "tokens long"), 1010.0, entropy=0.5)
    w = np.array([1000.0, 10.0]) ** entropy
    assert mixing.entropy_of((w / w.sum()).tolist()) == pytest.approx(0.5, abs=1e-6)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_toxicity(spark):
    r = np.random.default_rng(1)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(r.choice(vocab, 60)) + (" you awful scoundrel" if i % 3 == 0 else ""), "a") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(frame(spark, rows + [(900, None, "a"), (None, "", "a")]), labels).collect()
    assert all(x.predicted == int(x.doc_id % 3 == 0) for x in got if x.doc_id is not None and x.doc_id < 300)
    assert [x.predicted for x in got if x.doc_id in (900, None)] == [0, 0]
    assert toxicity.score_documents(frame(spark, rows[:3]), labels.where("false")).count() == 3
    model = ({"scoundrel": 2.0, "scou-^": 1.0, "*exclaims": 0.5}, -1.0)
    assert toxicity.Scorer(*model)("Scoundrel, hm!!") == pytest.approx(toxicity.score("Scoundrel, hm!!", *model))


def test_quality_net(spark):
    for n in (0, 1, 511, 512, 513, 1020, 5000):
        text = bytes(range(1, 252)) * 20
        x = quality_net.pieces(text[:n])
        seen = {bytes(p[i : i + quality_net.WIDTH]) for p in x for i in range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE)}
        assert all(text[i : i + quality_net.WIDTH] in seen for i in range(0, n - quality_net.WIDTH + 1, quality_net.STRIDE))
    rows = [(i, ("plain words of a text " * 20 if i % 2 else "BAD$$ @@ ##!! " * 20) + str(i), "a") for i in range(120)] + [(900, None, "a")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_net.score_documents(frame(spark, rows), labels).collect()}
    assert all((got[i].score > 0.5) == bool(i % 2) for i in range(120)) and 0 <= got[900].score <= 1


def test_pipeline(spark, corpus):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    long = [(i, t + "\nthe " + " ".join(f"x{i}y{k}" for k in range(60)), s) for i, t, s in corpus]
    docs = frame(spark, long + [(i and i + 300, t, s) for i, t, s in EDGES]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = out
    assert docs.count() >= 60


def test_pii_added_spans(spark):
    """Forms that the base patterns cannot see are added once the trees have seen enough base forms; plain numbers and prose are not."""
    luhn = lambda d: next(d + str(c) for c in range(10) if sum(sum(divmod(int(x) * (1 + (i % 2)), 10)) for i, x in enumerate(reversed(d + str(c)))) % 10 == 0)
    rows = [(i, f"mail user{i}@site{i % 7}.com now\nserver 10.0.{i % 200}.7 up, level 999.1.1.{i}\ncard {luhn(f'4111{i:011d}')} or code {i:04d} 5555\ncall +1 (555) 010-{i:04d} or item {i:03d} 1234 56789", "a") for i in range(300)]
    amex = luhn("37828224631000")
    asked = {
        1000: ("write to jane (at) example (dot) org today", "email", "jane (at) example (dot) org"), 1001: ("Phone number is 030 1234 5678, thanks", "phone", "030 1234 5678"),
        1002: (f"my card {amex} please", "card", amex), 1003: ("the host 10[.]1[.]2[.]33 was down", "ip", "10[.]1[.]2[.]33"),
        1004: ("meet at noon dot matrix", None, ""), 1005: ("in 2020 1234 5678 pieces and 1.2.3 and 300[.]1[.]1[.]1", None, ""), 1006: ("é\U0001f600 mail bob at site dot net", "email", "bob at site dot net"),
    }
    docs = frame(spark, rows + [(i, t, "a") for i, (t, _, _) in asked.items()] + [(None, asked[1000][0], "a")]).withColumn("base", F.lit(1)).withColumn("loose", F.lit(1))
    found = pii.find(docs).collect()
    assert len(found) == len(rows) + len(asked) + 1
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in found}
    for i, (t, kind, span) in asked.items():
        assert got[i] == ([(kind, t.index(span), t.index(span) + len(span))] if kind else []), t
    assert got[None] == got[1000]
    assert all(len(got[i]) == 4 and [x[0] for x in got[i]] == list(pii.KINDS) for i, _, _ in rows)


def brute_base(text):
    """The contract's base spans, with plain patterns."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0]))


def test_pii_base_against_brute_force(spark):
    r = np.random.default_rng(3)
    pieces = ["a", "é", "\U0001f600", "@", ".", "-", " ", "+", "(", ")", "_", "1", "25", "300", "4111 1111 1111 1111", "x@y.zz", "10.0.0.1", "+49 30 1234567", "0", "\n"]
    texts = ["".join(r.choice(pieces, r.integers(1, 40))) for _ in range(1500)]
    got = {row.doc_id: row for row in pii.digest(pii.find(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]))).collect()}
    wrong = [t for i, t in enumerate(texts) if got[i].base_sha256 != hashlib.sha256(brute_base(t).encode()).hexdigest()]
    assert not wrong, wrong[:3]
    assert all(set(filter(None, brute_base(t).split(","))) <= set(got[i].spans.split(",")) for i, t in enumerate(texts))
