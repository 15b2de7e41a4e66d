"""Fused blends, repeated folds, strategies and shots against plain versions."""

import hashlib
import random
import statistics

import numpy as np
import pytest

from mortise.operators import fusion as fu

ROWS = "id long, a double, b double, c double"


def made(n, seed=1):
    rng = random.Random(seed)
    some = lambda at: rng.choice([None, rng.choice([at, at + 1.0, at + 2.5, rng.gauss(at, 3)])])
    return [(i, some(10.0), some(13.0), some(90.0)) for i in range(n)]


def test_fuse(spark):
    rows = made(200)
    source = [(x,) for x in (6.0, 9.0, 15.0, 14.0)]
    got = {r["id"]: r for r in fu.fuse(spark.createDataFrame(rows, ROWS), ("a", 0.5), {"b": 0.3, "c": 0.2}, spark.createDataFrame(source, "y double"), "y", 5.0).collect()}
    a, b = ([r[k] for r in rows if r[k] is not None] for k in (1, 2))
    up = statistics.median(a) - statistics.median(b)
    want = {}
    for i, x, y, _ in rows:
        parts = [(0.5, x)] * (x is not None) + [(0.3, y + up if y is not None else None)] * (y is not None)
        want[i] = min(15.0, max(6.0, sum(w * v for w, v in parts) / sum(w for w, _ in parts))) if parts else None
    assert {r["b_used"] for r in got.values()} == {1} and {r["c_used"] for r in got.values()} == {0}
    assert len(got) == len(rows) and any(v is None for v in want.values())
    values = [got[i]["fused"] for i in want if want[i] is not None]
    for i, v in want.items():
        assert got[i]["fused"] == (pytest.approx(v) if v is not None else None)
        f = got[i]["fused"]
        assert got[i]["place"] == (None if f is None else sum(o < f for o in values) + (sum(o == f for o in values) + 1) / 2)


def test_fuse_without_rows_or_source(spark):
    source = spark.createDataFrame([], "y double")
    assert fu.fuse(spark.createDataFrame([], ROWS), ("a", 1.0), {"b": 1.0}, source, "y", 1.0).count() == 0
    rows = fu.fuse(spark.createDataFrame(made(20), ROWS), ("a", 1.0), {"b": 1.0}, source, "y", 1.0).collect()
    assert all(r["fused"] == r["a"] and r["b_used"] == 0 and r["b_shift"] is None for r in rows)


def test_repeated_folds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "c", "d", "e", "f", "a"]), rng.choice([None, rng.gauss(5, 2), rng.gauss(5, 2)]), rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1), 4.0])) for i in range(150)]
    by_row, errors = fu.repeated_folds(spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(4), "id", "g", "x", "y", repeats=4, folds=3, full=0.65)
    fold = lambda g, k: int(hashlib.md5(f"{g or ''}:{k}".encode()).hexdigest()[:8], 16) % 3
    fit = lambda rs: np.polyfit([r[2] for r in rs], [r[3] for r in rs], 1)
    whole = [r for r in rows if r[2] is not None and r[3] is not None]
    lines = {(k, f): fit([r for r in whole if fold(r[1], k) != f]) for k in range(4) for f in {fold(r[1], k) for r in whole}}
    all_, mean = fit(whole), np.mean(list(lines.values()), axis=0)
    got = {r["id"]: r for r in by_row.collect()}
    assert len(got) == len(rows)
    maes = [np.mean([abs(np.polyval(lines[k, fold(r[1], k)], r[2]) - r[3]) for r in whole]) for k in range(4)]
    for i, g, x, _ in rows:
        if x is None:
            assert got[i]["oof"] is None and got[i]["blended"] is None
        else:
            assert got[i]["oof"] == pytest.approx(np.mean([np.polyval(lines[k, fold(g, k)], x) for k in range(4)]))
            assert got[i]["blended"] == pytest.approx(0.65 * np.polyval(all_, x) + 0.35 * np.polyval(mean, x))
    e = errors.first()
    assert (e["mae_mean"], e["mae_std"]) == (pytest.approx(np.mean(maes)), pytest.approx(np.std(maes)))


def test_repeated_folds_of_no_rows(spark):
    by_row, errors = fu.repeated_folds(spark.createDataFrame([], "id long, g string, x double, y double"), "id", "g", "x", "y")
    assert by_row.count() == 0
    assert errors.first()["mae_mean"] is None


def test_strategy_quality(spark):
    nan = float("nan")
    rows = [("s", 1.0, 2.0, 1.0), ("s", 3.0, 4.0, None), ("s", None, 9.0, 5.0), ("none", None, 1.0, 2.0), ("none", 0.0, 3.0, nan), ("gap", 1.0, None, 1.0), ("gap", 0.0, 5.0, 3.0), (None, 2.0, 1.0, 1.0)]
    got = {r["s"]: tuple(r)[1:] for r in fu.strategy_quality(spark.createDataFrame(rows, "s string, w double, r double, m double"), "s", "w", ["r", "m"]).collect()}
    assert got == {"s": (3, 3.5, 1.0, 1.0), "none": (2, 2.0, 2.0, 1.0), "gap": (2, None, 1.0, 0.5), None: (1, 1.0, 1.0, 1.0)}


def test_shot_summary(spark):
    nan = float("nan")
    rows = [(1, "a", 2.0, 0.1), (1, "b", 1.0, 0.1), (1, "c", 1.0, 0.4), (1, "d", 1.0, 0.4), (1, "e", nan, 9.0), (2, "a", None, 1.0), (3, "z", 5.0, None), (3, "y", 5.0, nan)]
    got = {r["shot"]: r for r in fu.shot_summary(spark.createDataFrame(rows, "shot int, run string, e double, o double"), "shot", "e", "o", "run").collect()}
    assert [got[1][c] for c in ("n", "mean", "median", "best_run", "best_error", "best_order")] == [4, 1.25, 1.0, "c", 1.0, 0.4]
    assert got[1]["q90"] == pytest.approx(1.7)
    assert [got[2][c] for c in ("n", "mean", "median", "best_run", "best_order")] == [0, None, None, None, None]
    assert [got[3][c] for c in ("n", "best_run", "best_order")] == [2, "y", None]
