"""Operators that SQL can't express, against brute force; parsing and null cases."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mortise.functions import parsing
from mortise.operators import calibration, records, structures


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_least_cost_is_cheapest():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 3), (4, 4), (5, 6), (3, 6)] * 4:
        cost = r.random((n, m)).round(1)
        got = structures.least_cost(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and np.isclose(cost[range(n), got].sum(), best)


SITES = "structure_id long, idx long, symbol string, fx double, fy double, fz double"


def test_assignment_and_neighbours(spark):
    a = spark.createDataFrame([(1, 0, "O", 0.02, 0.0, 0.0), (1, 1, "O", 0.5, 0.5, 0.5), (1, 2, "Ti", 0.1, 0.1, 0.1), (2, 0, "O", None, 0.0, 0.0)], SITES)
    b = spark.createDataFrame([(1, 7, "O", 0.45, 0.5, 0.5), (1, 8, "O", 0.98, 0.0, 0.0), (1, 9, "Ti", 0.6, 0.6, 0.6)], SITES)
    got = [(r.structure_id, r.symbol, r.i, r.j, round(r.dist, 6)) for r in structures.assign(a, b, 0.3).collect()]
    assert sorted(got) == [(1, "O", 0, 8, 0.04), (1, "O", 1, 7, 0.05)]
    cell = spark.createDataFrame([(1, 3.0, 4.0, 5.0, 90.0, 90.0, 120.0)], "structure_id long, a double, b double, c double, alpha double, beta double, gamma double")
    found = structures.neighbours(a, cell, 3.5, 2).collect()
    x = a.where("structure_id = 1").orderBy("idx").toPandas()[["fx", "fy", "fz"]].to_numpy()
    m = np.array([[3, 0, 0], [4 * np.cos(np.radians(120)), 4 * np.sin(np.radians(120)), 0], [0, 0, 5]])
    want = []
    for i, j in itertools.product(range(3), repeat=2):
        for k in itertools.product(range(-3, 4), repeat=3):
            d = float(np.linalg.norm((x[j] - x[i] + k) @ m))
            if 1e-9 < d <= 3.5:
                want.append((i, j, round(d, 6)))
    assert sorted((r.i, r.j, round(r.dist, 6)) for r in found) == sorted(want)
    assert structures.assign(a.limit(0), b.limit(0), 1.0).count() == 0


def test_farthest_points(spark):
    r = np.random.default_rng(1).random((9, 3))
    s = spark.createDataFrame(pd.DataFrame({"structure_id": 1, "idx": range(9), "symbol": "O", "fx": r[:, 0], "fy": r[:, 1], "fz": r[:, 2]}))
    got = [x.idx for x in structures.farthest_points(s, 4).orderBy("place").collect()]
    want = [int(np.linalg.norm(r - r.mean(0), axis=1).argmax())]
    while len(want) < 4:
        want.append(max((k for k in range(9) if k not in want), key=lambda k: min(np.linalg.norm(r[k] - r[w]) for w in want)))
    assert got == want


def test_layers_anchor_at_their_start(spark):
    s = spark.createDataFrame([(1, i, "O", 0.0, 0.0, z) for i, z in enumerate([0.0, 0.08, 0.16, 0.24])] + [(2, 0, "O", 0.0, 0.0, None)], SITES)
    assert rows(structures.layers(s, "fz", 0.1)) == [(1, 2)]
    assert rows(structures.remove_top(s.where("structure_id = 1"), "fz").select("idx")) == [(0,), (1,), (2,)]


def test_quotas(spark):
    r = np.random.default_rng(2)
    data = [(int(g), i, float(s), str(m), str(f)) for i, (g, s, m, f) in enumerate(zip(r.integers(0, 4, 300), r.random(300).round(1), r.integers(0, 5, 300), r.integers(0, 6, 300), strict=True))]
    got = rows(records.quota_selection(spark.createDataFrame([*data, (0, 999, None, "1", None)], "g int, i int, s double, m string, f string"), "g", "i", "s", "m", "f", 8, 3, 2))
    want = []
    for g in range(4):
        taken, modes, families = 0, {}, {}
        for _, i, _, m, f in sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[1])):
            if taken < 8 and modes.get(m, 0) < 3 and families.get(f, 0) < 2:
                taken += 1
                modes[m], families[f] = modes.get(m, 0) + 1, families.get(f, 0) + 1
                want.append((g, i, taken))
    assert got == sorted(want)


def test_quotas_need_no_call_for_each_group(spark):
    got = records.quota_selection(spark.createDataFrame([(1, 2, 3.0, "m", "f"), (2, 3, 3.0, "m", "f")], "g int, i int, s double, m string, f string"), "g", "i", "s", "m", "f", 8, 3, 2)
    assert "Pandas" not in got._jdf.queryExecution().toString() and rows(got) == [(1, 2, 1), (2, 3, 1)]


def test_budget_skips(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4), (1, 4, 1), (1, 5, 1), (2, 1, 99), (3, 1, None)], "k int, i int, s int")
    assert rows(records.greedy_budget(df, "k", "i", "s", "i", 10)) == [(1, 1, 5), (1, 3, 9), (1, 4, 10)]


def test_forecast_continues(spark):
    line = [("line", d, 3.0 * d) for d in range(30)]
    wave = [("wave", d, float(np.sin(d))) for d in range(60)]
    got = records.forecast(spark.createDataFrame([*line, *wave, ("short", 0, 7.0), ("empty", 0, None)], "g string, d int, v double"), "g", "d", "v", 3).collect()
    by = {g: [r.forecast for r in sorted(got, key=lambda r: r.step) if r.g == g] for g in ("line", "wave", "short", "empty")}
    assert np.allclose(by["line"], [90, 93, 96]) and np.allclose(by["wave"], np.sin([60, 61, 62]), atol=1e-3)
    assert by["short"] == [7.0] * 3 and all(v is None or v != v for v in by["empty"])


def test_rake_small(spark):
    df = spark.createDataFrame([(1, "Deep water waves of the deep sea, deep water"), (2, ""), (3, None), (4, "the of")], "k int, t string")
    got = rows(records.rake(df, "k", "t", ("the", "of")).select("k", "place", "phrase", "score"))
    # deep: 3 phrases of 3 + 2 + 2 words; water: 3 + 2 over 2; waves: 3; sea: 2
    assert got == [(1, 1, "deep water waves", round(7 / 3 + 5 / 2 + 3, 6)), (1, 2, "deep water", round(7 / 3 + 5 / 2, 6)), (1, 3, "deep sea", round(7 / 3 + 2, 6))]


def test_names_in_texts(spark):
    names = spark.createDataFrame([("New York",), ("York",), ("Oslo",), (None,)], "n string")
    docs = spark.createDataFrame([(1, "in new  york, today"), (2, "Yorkshire"), (3, None), (4, "Oslo or York")], "k int, t string")
    assert rows(records.text_contains(docs, "k", "t", names, "n")) == [(1, "New York"), (1, "York"), (2, "Others"), (3, "Others"), (4, "Oslo"), (4, "York")]
    assert rows(records.text_contains(docs.limit(0), "k", "t", names, "n")) == []


@pytest.mark.parametrize(
    ("expression", "text", "want"),
    [
        (parsing.parse_list, '["a", " b", "a", "n/a"]', ["a", "b"]), (parsing.parse_list, "a; b and c|none", ["a", "b", "c"]), (parsing.parse_list, None, None),
        (parsing.yes_no, " Yes", True), (parsing.yes_no, "maybe", None), (parsing.number, "about −1,234.5e1 eV", -12345.0), (parsing.number, "none", None),
        (parsing.miller, "110", "(1 1 0)"), (parsing.miller, "(1,-1, 0)", "(1 -1 0)"), (parsing.miller, "x", "(? ? ?)"), (parsing.clean_null, " N/A ", None),
        (lambda c: parsing.formula(c)["atoms"], "Fe2O3", 5), (lambda c: parsing.formula(c)["major"], "Fe2O3", "O"), (lambda c: parsing.formula(c)["atoms"], "", 0), (lambda c: parsing.clip(c, 3), "ab cd", "ab ...[TRUNCATED]"),
    ],
)
def test_parsing(spark, expression, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x == want


def test_calibration_edges(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0), (None, 1.0, 3.0)], "g string, p double, y double")
    assert [r.calibrated for r in calibration.affine(df, "g", "p", "y").collect()] == [1.0, 1.0, 1.0]
    off = {r.g: r.calibrated for r in calibration.shrunken_offset(df, "g", "p", "y", 1.0, 0.5).collect()}
    assert off["a"] == 1.0 and off["b"] == 1.25
    m = calibration.classification(df.limit(0), ["g"], F.col("p").cast("int"), F.col("y").cast("int"))
    assert m.count() == 0
