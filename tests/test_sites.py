"""Links between records and sites against a plain version over all pairs, fills, and support of fields."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mortise.functions import support as su
from mortise.operators import sites as si
from mortise.registry import queries

SITES = "g string, place long, site string, label string, kind string, active string, text string, chunks array<string>, n_fields int, size int"
RECORDS = "g string, record string, site string, text string, config string, chunks array<string>"


def plain(x):
    return re.sub(r"[^a-z0-9+\-]+", " ", (x or "").lower()).strip()


def words(x):
    return {t for t in plain(x).split() if len(t) >= 2 and t not in si.COMMON}


def score(s, r):
    text = plain(r["text"])
    n = min(25, 5 * len(words(s["text"]) & words(r["text"]))) + min(30, 12 * len({c for c in s["chunks"] or [] if c} & set(r["chunks"] or []))) + min(15, 2 * s["n_fields"])
    active = (s["active"] or "").lower()
    n += 20 * bool(active and active in text) + 15 * bool(active and active in plain(r["config"]))
    return (n + 25 * bool(plain(s["label"]) and plain(s["label"]) in text) + 15 * bool(plain(s["kind"]) and plain(s["kind"]) in text)) / 100


def best(r, sites):
    own = sorted((s for s in sites if s["g"] == r["g"] and r["g"] is not None), key=lambda s: s["place"])
    same = [s for s in own if r["site"] and s["site"] == r["site"]]
    if same:
        return "exact_site_id", 1.0, same[0]["place"]
    own = [s for s in own if s["n_fields"] > 0]
    if len(own) == 1:
        return "unique_system_site", 0.82, own[0]["place"]
    scored = sorted(((score(s, r), s["place"]) for s in own), key=lambda x: -x[0])
    if scored and scored[0][0] >= 0.26 and (scored[0][0] - (scored[1][0] if len(scored) > 1 else 0.0) >= 0.04 or scored[0][0] >= 0.45):
        return "fuzzy_site_match", min(0.78, max(0.55, scored[0][0])), scored[0][1]
    return "unlinked", 0.0, None


def made(seed, hot=60):
    rng = random.Random(seed)
    vocabulary = ["fe", "ti", "oxygen", "bridge", "top", "hollow", "vacancy", "step", "edge", "110", "site", "x"]
    some = lambda k: " ".join(rng.choices(vocabulary, k=k))
    sites, records = [], []
    for g, n in [("a", 1), ("b", 3), ("c", 6), ("hot", hot), ("none", 0), (None, 2)]:
        for p in range(n):
            sites.append({"g": g, "place": p, "site": rng.choice([None, f"s{p % 4}", ""]), "label": rng.choice([None, "", some(1), some(2)]), "kind": rng.choice([None, "Top", "bridge-x"]), "active": rng.choice([None, "Fe", "Ti", "O(2)"]),
                          "text": rng.choice([None, some(3), some(6)]), "chunks": rng.choice([None, [], ["1", None], ["2", "3", "3"]]), "n_fields": rng.choice([0, 0, 1, 4, 11]), "size": rng.choice([None, p])})
        if g == "a":
            sites[-1]["n_fields"] = 4
        else:
            sites += [dict(s, place=s["place"] + 1000) for s in sites if s["g"] == g and g is not None]
        for k in range(max(3, n)):
            records.append({"g": g, "record": f"{g}-{k}", "site": rng.choice([None, None, "s1", "gone"]), "text": rng.choice([None, "", some(2), some(5), "offensive " + some(4)]), "config": rng.choice([None, some(1)]), "chunks": rng.choice([None, ["1"], ["3", "2"]])})
    return sites, records


@pytest.mark.parametrize(("seed", "block"), [(1, 5000), (2, 3), (3, 1)])
def test_links(spark, monkeypatch, seed, block):
    monkeypatch.setattr(si, "BLOCK", block)
    sites, records = made(seed)
    rows = si.link_sites(spark.createDataFrame(sites, SITES).repartition(5), spark.createDataFrame(records, RECORDS).repartition(3), ["g"]).collect()
    got = {r["record"]: (r["method"], r["confidence"], r["place"]) for r in rows}
    want = {r["record"]: best(r, sites) for r in records}
    assert len(rows) == len(records)
    assert got == want
    assert {m for m, _, _ in want.values()} == {"exact_site_id", "unique_system_site", "fuzzy_site_match", "unlinked"}


def test_links_of_empty_tables(spark):
    sites, records = made(4, 5)
    s, r = spark.createDataFrame(sites, SITES), spark.createDataFrame(records, RECORDS)
    assert si.link_sites(s, r.limit(0), ["g"]).count() == 0
    assert {x["method"] for x in si.link_sites(s.limit(0), r, ["g"]).collect()} == {"unlinked"}


def shuffled(spark, make):
    """Bytes that running what make() returns writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))

    before = total()
    make().write.format("noop").mode("overwrite").save()
    return total() - before


def test_links_do_not_shuffle_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    sites = [(p, f"s{p}", text(1), text(1), "Fe", text(40), [str(p % 5)], 3, p) for p in range(400)]
    records = [(f"r{k}", None, text(20), text(5), [str(k % 5)]) for k in range(400)]

    def run(size):
        s = spark.createDataFrame([(str(i // size), *x) for i, x in enumerate(sites)], SITES)
        r = spark.createDataFrame([(str(i // size), *x) for i, x in enumerate(records)], RECORDS)
        return lambda: si.link_sites(s, r, ["g"])

    apart, together = shuffled(spark, run(10)), shuffled(spark, run(400))
    assert 0 < together < 2 * apart  # 40 times the pairs


def test_record_fills_do_not_shuffle_pairs(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(60)]
    said = [("assistant" if i % 2 else "user", " ".join(rng.choices(vocabulary, k=40))) for i in range(600)]
    cost = {}
    for size in (12, 600):
        rows = [(i // size, i % size, *x) for i, x in enumerate(said)]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{size}/conversations.parquet")
        cost[size] = shuffled(spark, lambda: queries()["record_fills"](spark, f"{tmp_path}/{size}"))
    assert 0 < cost[600] < 2 * cost[12]  # 50 times the pairs


def test_fill(spark):
    sites = spark.createDataFrame([("a", 1, None, None, None, None, "x", None, 2, 7)], SITES)
    records = spark.createDataFrame([("a", "r1", None, None), ("a", "r2", None, 3), ("b", "r3", None, None)], "g string, record string, site string, size int")
    full = records.withColumns({"text": F.lit("x"), "config": F.lit(None).cast("string"), "chunks": F.lit(None).cast("array<string>")})
    links = si.link_sites(sites, full, ["g"])
    got = {r["record"]: (r["size"], r["method"], r["repaired"]) for r in si.fill_from_sites(records, links, sites, ["g"], ["size"]).collect()}
    assert got == {"r1": (7, "unique_system_site", ["size"]), "r2": (3, "unique_system_site", []), "r3": (None, "unlinked", [])}


def test_link_score(spark):
    yes, no = F.lit(True), F.lit(None).cast("boolean")
    row = spark.range(1).select(si.link_score(yes, yes, yes, yes, yes, yes, yes, F.lit(1.0)), si.link_score(no, no, no, no, no, no, no, F.lit(None).cast("double")), si.link_score(yes, no, yes, yes, no, no, no, F.lit(0.82))).first()
    assert list(row) == [1.0, 0.15, 0.741]


def test_support(spark):
    rows = [("bridge site", "The BRIDGE site holds", 1.26, "eV"), ("Fe-top", "a top layer at 1.27 eV", 1.26, "eV"), ("hollow place", "the place", 2.5, "eV"), (None, "x", None, "eV"), ("x", None, 1.0, "eV"), (" ", "x 1.00", 1.0, None)]
    df = spark.createDataFrame(rows, "t string, e string, v double, v_unit string")
    e = F.col("e")
    got = df.select(su.text_supported(F.col("t"), e), su.field_status(["v"], ["t"], e), su.match_score([F.col("t"), F.lit("none"), F.lit("bridge")], e)).collect()
    assert [r[0] for r in got] == [True, False, True, False, True, False]
    assert [r[1]["v"] for r in got] == ["unsupported", "supported", "unsupported", "missing", "unsupported", "supported"]
    assert [r[1]["t"] for r in got] == ["supported", "weak_or_unsupported", "supported", "missing", "supported", "weak_or_unsupported"]
    assert [r[2] for r in got] == [1.0, 0.0, 0.25, 0.0, 0.0, 0.0]
    kept = df.withColumns(su.drop_unsupported(["v"], {"v": "v_unit"}, e)).collect()
    assert [(r["v"], r["v_unit"]) for r in kept] == [(None, None), (1.26, "eV"), (None, None), (None, "eV"), (None, None), (1.0, None)]
    assert [r["number_status"]["v"] for r in kept] == ["dropped_not_in_evidence", "supported", "dropped_not_in_evidence", "missing", "dropped_not_in_evidence", "supported"]
