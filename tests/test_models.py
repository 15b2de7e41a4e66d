"""Places, folds, importance, selection, models and lattice choices against plain versions and known answers."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mortise.operators import arima, components, folds, importance, lattices, ranks
from mortise.plans import lattices as plans


def test_places_in_groups_with_nulls_and_skew(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 1.0, 2.0, 2.0, -5.0]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(7)
    got = ranks.numbered(df, [F.desc_nulls_last("v"), F.col("id")], ["g"]).collect()
    want = {}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        want |= {x[2]: k for k, x in enumerate(own)}
    assert {x.id: x.place for x in got} == want and got[0].__fields__ == ["g", "v", "id", "place"]
    assert [x.place for x in ranks.numbered(df.where("false"), [F.col("id")]).collect()] == []
    whole = ranks.numbered(df, [F.col("id")]).collect()
    assert sorted((x.id, x.place) for x in whole) == [(i, i) for i in range(500)]


def test_running_sums_over_ranges(spark):
    rows = [(i % 37, i) for i in range(400)]
    got = ranks.running_sum(spark.createDataFrame(rows, "k int, v int").repartition(5), "k", "v", "upto").collect()
    want = {k: sum(v for j, v in rows if j <= k) for k in range(37)}
    assert len(got) == 400 and all(x.upto == want[x.k] for x in got)
    assert ranks.running_sum(spark.createDataFrame([], "k int, v int"), "k", "v", "upto").collect() == []


def test_group_quantiles_equal_numpy(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y"]), r.choice([None, r.random(), 1.0, 5.0])) for _ in range(600)] + [("lone", "x", 3.0), ("none", "x", None)]
    got = ranks.group_quantiles(spark.createDataFrame(rows, "g string, h string, v double").repartition(5), ["g", "h"], "v", {"q1": 0.25, "median": 0.5, "top": 1.0}).collect()
    by = defaultdict(list)
    for g, h, v in rows:
        if v is not None:
            by[g, h].append(v)
    assert {(x.g, x.h): (x.q1, x.median, x.top) for x in got} == {k: pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 1.0]))) for k, v in by.items()}


def test_stratified_folds_keep_groups_whole_and_labels_balanced(spark):
    r = random.Random(3)
    rows = [(g, r.choices("xyz", [1 + (g % 3 == 0) * 8, 1 + (g % 3 == 1) * 8, 1])[0]) for g in range(400) for _ in range(r.choice([1, 2, 3, 40]))] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "g int, y string")
    got = folds.stratified_group_folds(df.repartition(6), "g", "y", 4, seed=5).collect()
    assert sorted(got, key=str) == sorted(folds.stratified_group_folds(df.repartition(1), "g", "y", 4, seed=5).collect(), key=str)
    fold = {x.g: x.fold for x in got}
    assert len(got) == 401 and set(fold.values()) == {0, 1, 2, 3}
    strata = defaultdict(lambda: ([0] * 4, [0]))
    for x in got:
        strata[x.stratum][0][x.fold] += x.n
        strata[x.stratum][1].append(x.n)
    assert all(max(s) - min(s) <= 2 * max(n) for s, n in strata.values())
    by = Counter((y, fold[g]) for g, y in rows)
    for y in "xyz":
        own = [by[y, k] for k in range(4)]
        assert max(own) - min(own) <= 0.15 * sum(own), own


def test_repeated_leave_out_and_three_parts(spark):
    df = spark.createDataFrame([(g,) for g in range(103)] * 2, "g int")
    got = folds.repeated_group_folds(df, "g", 5, 3).collect()
    sizes = Counter((x["repeat"], x.fold) for x in got)
    assert len(got) == 309 and set(sizes.values()) <= {20, 21} and len({tuple(x.fold for x in sorted(got, key=lambda x: x.g) if x["repeat"] == k) for k in range(3)}) == 3
    assert sorted((x.g, x.fold) for x in folds.leave_one_group_out(df, "g").collect()) == [(g, g) for g in range(103)]
    assert Counter(x.part for x in folds.train_validation_test(df, "g").collect()) == {"train": 82, "validation": 11, "test": 10}


def test_importance_is_of_what_the_prediction_uses(spark):
    r = random.Random(4)
    rows = [(i, r.random(), r.random(), r.random()) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").withColumn("y", 5 * F.col("a") + F.col("b"))
    of = lambda d: importance.permutation_importance(d, "id", ["a", "b", "c"], "y", lambda x: x.withColumn("prediction", 5 * F.col("a") + F.col("b")), repeats=4, seed=1).collect()
    got = of(df.repartition(9))
    assert got == of(df.coalesce(1)) and [x.feature for x in got] == ["a", "b", "c"] and got[2].importance == 0 == got[2].spread
    a = np.array([x[1] for x in rows])
    assert got[0].mae == pytest.approx(5 * np.abs(a[:, None] - a[None]).mean(), rel=0.05)


def test_permutation_importance_over_many_ranges_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 50)
    r = random.Random(4)
    rows = [(f"k{i}", r.random(), r.choice([1.0, 2.0]), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, a double, b double, y double").repartition(5)
    got = {x.feature: x for x in importance.permutation_importance(df, "id", ["a", "b"], "y", lambda x: x.withColumn("prediction", F.col("a") * F.col("b")), repeats=3, seed=5).collect()}
    placed = sorted(rows)
    for i, f in enumerate("ab"):
        each = []
        for k in range(3):
            dealt = sorted(rows, key=lambda x: hashlib.md5(f"5:{k}:{f}:{x[0]}".encode()).hexdigest())
            each.append(np.mean([abs((d[1] if f == "a" else p[1]) * (d[2] if f == "b" else p[2]) - p[3]) for p, d in zip(placed, dealt, strict=True)]))
        assert (got[f].mae, got[f].spread) == pytest.approx((np.mean(each), np.std(each)))


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))

    before = total()
    run()
    return total() - before


def test_permutation_importance_shuffles_packs_of_values(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 100_000)
    r = np.random.default_rng(2)
    rows = [(f"{i:06}", float(a), float(b) if i % 7 else None) for i, (a, b) in enumerate(zip(r.uniform(size=10_000).round(4), r.integers(0, 9, 10_000)))]
    df = spark.createDataFrame(rows, "id string, a double, b double").withColumn("y", F.col("a") + 1)
    predict = lambda x: x.withColumn("prediction", F.col("a") + F.coalesce("b", F.lit(-5.0)))
    run = lambda repeats: {x.feature: x for x in importance.permutation_importance(df, "id", ["a", "b"], "y", predict, repeats=repeats, seed=3).collect()}
    few, many = shuffled(spark, lambda: run(1)), shuffled(spark, lambda: run(21))
    assert (many - few) / 20 / (2 * len(rows)) < 16  # bytes a value: 8 of its hash, and what the value takes
    got = run(2)["b"]
    dealt = [sorted(rows, key=lambda x: hashlib.md5(f"3:{k}:b:{x[0]}".encode()).hexdigest()) for k in range(2)]
    each = [np.mean([abs(x[1] + (-5.0 if d[2] is None else d[2]) - x[1] - 1) for x, d in zip(rows, way, strict=True)]) for way in dealt]
    assert (got.mae, got.spread) == pytest.approx((np.mean(each), np.std(each)))


def test_models_are_fitted_on_as_many_parts_as_cores(spark):
    parts = []

    class Zero:
        def fit(self, df, features, target):
            parts.append(df.rdd.getNumPartitions())
            return lambda other: other.withColumn("prediction", F.lit(0.0))

    df = spark.createDataFrame([(float(i), float(i), i % 2) for i in range(40)], "x double, y double, fold int").coalesce(1)
    got = components.cross_validated(df, ["x"], "y", "fold", {"zero": Zero()}).collect()
    assert sorted((x.fold, x.n, x.mae) for x in got) == [(0, 20, 19.0), (1, 20, 20.0)] and set(parts) == {spark.sparkContext.defaultParallelism}


def plain_diverse(rows, k):
    """rows: (id, base, disagreement), None last."""
    low = lambda x: -x[2] if x[2] is not None else math.inf
    rows = sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, low(x), x[0]))
    kk = min(k, max(0, len(rows) - 1))
    out = []
    for spot in np.linspace(0, len(rows) - 1, kk).round().astype(int).tolist() if kk else []:
        near = sorted(rows[max(0, spot - 1) : spot + 2], key=low)
        out += [x[0] for x in near if x[0] not in out][:1]
    rest = [x[0] for x in sorted(rows, key=low) if x[0] not in out]
    return set(out + rest[: kk - len(out)])


@pytest.mark.parametrize("k", [1, 2, 5, 17, 40])
def test_diverse_selection_equals_plain(spark, k):
    r = random.Random(k)
    groups = {g: [(100 * n + i, r.choice([None, 1.0, 2.0, r.random()]), r.choice([None, 0.5, r.random(), 0.5])) for i in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 18), ("d", 41), ("e", 90))}
    df = spark.createDataFrame([(g, *x) for g, rows in groups.items() for x in rows], "g string, id int, p double, d double").repartition(4)
    got = defaultdict(set)
    for x in importance.diverse_uncertain(df, "g", "id", "p", "d", k).collect():
        assert x.id not in got[x.g]
        got[x.g].add(x.id)
    assert got == {g: s for g, rows in groups.items() if (s := plain_diverse(rows, k))}


def test_components_equal_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)] + [(900, [1.0], 1), (901, None, 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1)], "id int, v array<double>, f int").repartition(3)
    fit = components.fit_components(df.where("f > 0"), "v", 6, 3)
    t = x[[i % 4 > 0 for i in range(200)]]
    values, axes = np.linalg.eigh(np.cov(t.T))
    axes = axes[:, ::-1][:, :3].T
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose(fit.axes, axes, atol=1e-8) and np.allclose(fit.shares, values[::-1][:3] / values.sum()) and np.allclose(fit.mean, t.mean(0))
    got = {y.id: [y.pc0, y.pc1, y.pc2] for y in components.project(df, "v", fit).collect()}
    assert np.allclose([got[i] for i in range(200)], (x - t.mean(0)) @ axes.T) and all(got[k] == [None] * 3 for k in (900, 901, 902, 903))
    assert len(components.fit_components(df.where("id < 3"), "v", 6, 5).axes) == 2 and len(components.fit_components(df.where("false"), "v", 6, 5).axes) == 0


def test_kernel_and_choice(spark):
    r = np.random.default_rng(6)
    x = r.uniform(-3, 3, (300, 2))
    y = np.sin(x[:, 0]) * x[:, 1] + 0.01 * r.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 0)], "a double, b double, y double, fold int")
    models = {"elastic": components.grid()["elastic_0.001"], "kernel": components.Kernel(gamma=0.5, landmarks=80), "forest": components.grid(1)["forest_4"]}
    scores = components.cross_validated(df, ["a", "b"], "y", "fold", models).cache()
    by = {m: np.mean([s.r2 for s in scores.collect() if s.model == m]) for m in models}
    assert scores.count() == 9 and sum(s.n for s in scores.collect()) == 900
    assert by["kernel"] > 0.97 and by["elastic"] < 0.3 < by["forest"] + 0.3 and components.chosen(scores) == "kernel"


def test_models_on_classes_equal_models_on_rows(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(float(a), float(b), float(3 * a - b * b + r.normal()), int(r.integers(3))) for a, b in zip(r.integers(0, 6, 3_000), r.integers(0, 4, 3_000))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int").repartition(5)
    x, y = np.array([z[:2] for z in rows]), np.array([z[2] for z in rows])
    own = [float(v) for v in components.Boosted(3, 10, 1).fit(df, ["a", "b"], "y")(df.select("a", "b", "y")).selectExpr("sum(prediction)", "sum(abs(prediction - y))").first()]
    plain = components.Estimated(components.GBTRegressor(maxDepth=3, maxIter=10, seed=1)).fit(df, ["a", "b"], "y")
    assert own == pytest.approx([float(v) for v in plain(df).selectExpr("sum(prediction)", "sum(abs(prediction - y))").first()], rel=1e-9)
    best = np.abs(y - np.array([y[(x == z).all(1)].mean() for z in x])).mean()
    spread = []
    for most in (10_000, 0):  # Spark's forest on rows, and trees on classes
        monkeypatch.setattr(components, "FOREST_ROWS", most)
        spread += [components.Forest(6, 8, 2).fit(df, ["a", "b"], "y")(df).selectExpr("avg(abs(prediction - y)) as e").first().e]
    assert all(best <= e < 0.5 * np.abs(y - y.mean()).mean() for e in spread) and spread[0] == pytest.approx(spread[1], rel=0.3), spread


def test_predictions_are_made_once_a_class(spark):
    seen = []

    class Mean:
        def fit(self, df, features, target):
            of = lambda other: seen.append(other.count()) or other.withColumn("prediction", F.col("x") * 2)
            return of

    df = spark.range(600).selectExpr("cast(id % 7 as double) as x", "cast(id as double) as y", "cast(id % 3 as int) as fold")
    got = components.cross_validated(df, ["x"], "y", "fold", {"mean": Mean()}).collect()
    assert seen == [7, 7, 7] and sorted((g.fold, g.n) for g in got) == [(0, 200), (1, 200), (2, 200)]
    assert {g.fold: g.mae for g in got} == {k: pytest.approx(np.mean([abs(i - 2 * (i % 7)) for i in range(600) if i % 3 == k])) for k in range(3)}


def simulated(n, phi, theta, seed, c=0.0):
    r = np.random.default_rng(seed)
    e, w = r.normal(size=n + 100), np.zeros(n + 100)
    for t in range(5, n + 100):
        w[t] = c + e[t] + sum(p * w[t - 1 - i] for i, p in enumerate(phi)) + sum(q * e[t - 1 - j] for j, q in enumerate(theta))
    return w[100:]


def test_moving_averages_are_recovered():
    v, _ = arima.fit_order(simulated(3000, [], [0.6], 1, 2.0), 0, 1)
    assert v == pytest.approx([2.0, 0.6], abs=0.06)
    v, _ = arima.fit_order(simulated(3000, [0.5], [-0.4], 2), 1, 1)
    assert v[1:] == pytest.approx([0.5, -0.4], abs=0.12)
    v, _ = arima.fit_order(simulated(3000, [], [0.9, 0.3], 3), 0, 2)
    assert v[1:] == pytest.approx([0.9, 0.3], abs=0.08)
    w = simulated(1500, [], [0.7], 4)
    p, q, v, _ = arima.best_order(w, 3, 0)
    e = arima.innovations(w, v[0], v[1 : 1 + p], v[1 + p :])
    assert q >= 1 and np.abs(arima.autocorrelations(e, 10)).max() < 0.08
    # the recursion against its definition
    w, phi, theta = simulated(40, [], [], 5), np.array([0.3, -0.2]), np.array([0.5, 0.1])
    e = arima.innovations(w, 0.4, phi, theta)
    for t in range(len(e)):
        back = [e[t - 1 - j] if t - 1 - j >= 0 else 0 for j in range(2)]
        assert e[t] == pytest.approx(w[t + 2] - 0.4 - phi @ w[[t + 1, t]] - theta @ back)


def test_arima_of_groups(spark):
    import datetime

    rows = [("line", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), 3.0 * i) for i in range(40)] + [("short", datetime.date(2000, 1, 1), 5.0), ("none", datetime.date(2000, 1, 1), None)]
    got = arima.arima_grid(spark.createDataFrame(rows, "g string, day date, v double"), "g", "day", "v", ahead=4).collect()
    by = {g: [x.forecast for x in sorted(got, key=lambda x: x.step) if x.g == g] for g in ("line", "short", "none")}
    assert by["line"] == pytest.approx([120.0, 123.0, 126.0, 129.0], abs=1e-3) and by["short"] == [5.0] * 4 and by["none"] == [None] * 4
    assert {x.p for x in got if x.g == "short"} == {None}


def test_subsets_equal_all_subsets(spark):
    r = random.Random(7)
    cases = [([r.choice([0, 1, 2, 3, 5, 9, 30]) for _ in range(r.randint(1, 10))], r.choice([0, 1, 7, 20])) for _ in range(40)]
    rows = [(k, i, s, t) for k, (sizes, t) in enumerate(cases) for i, s in enumerate(sizes)]
    got = {x.key: x for x in lattices.groups_near(spark.createDataFrame(rows, "key int, at int, size int, t int"), F.col("t")).collect()}
    for k, (sizes, target) in enumerate(cases):
        usable = [i for i, s in enumerate(sizes) if 1 <= s <= target]
        best = max((sum(sizes[i] for i in c), -sum(1 << i for i in c)) for n in range(len(usable) + 1) for c in itertools.combinations(usable, n) if sum(sizes[i] for i in c) <= target)
        assert (got[k].total, -sum(1 << i for i in got[k].chosen)) == best and got[k].chosen == sorted(got[k].chosen)


def test_subsets_where_the_table_ends_inside_a_structure(spark, tmp_path):
    spark.range(380, 396).select(F.col("id").alias("vec_id"), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(x) for x in plans.QUERIES["orbit_subsets"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(db.sql(plans.ORACLES["orbit_subsets"]).fetchall())


def test_template_pairs_at_least_distance(spark):
    r = random.Random(8)
    rows = [(k, i, 2, r.random(), r.random()) for k in range(12) for i in range(4)]
    template = [(0.05, 0.05), (0.5, 0.5)]
    got = {(x.key, x.at): x.matched for x in lattices.fit_template(spark.createDataFrame(rows, "key int, at int, size int, x double, y double"), template, 8).collect()}
    for k in range(12):
        d = {i: [math.dist((0, 0), [min(abs(a - b), 1 - abs(a - b)) for a, b in zip((x, y), p)]) for p in template] for kk, i, _, x, y in rows if kk == k}
        best = min(itertools.permutations(d, 2), key=lambda c: sum(d[i][j] for j, i in enumerate(c)))
        assert {i for i in range(4) if got[k, i]} == set(best)
    assert len(lattices.fit_template(spark.createDataFrame(rows, "key int, at int, size int, x double, y double"), [], 5).collect()) == 24


def test_near_cubic_equals_all_matrices(spark):
    cells = [(1, 3.0, 4.0, 6.1, 90.0, 90.0, 120.0), (2, 2.0, 2.0, 4.0, 80.0, 100.0, 95.0), (3, 5.0, 5.0, 5.0, 60.0, 60.0, 60.0)]
    got = {x.key: x for x in lattices.near_cubic(spark.createDataFrame(cells, "key int, a double, b double, c double, alpha double, beta double, gamma double"), most=1, largest=6).collect()}
    for key, a, b, c, al, be, ga in cells:
        ca, cb, cg, sg = (f(math.radians(x)) for f, x in ((math.cos, al), (math.cos, be), (math.cos, ga), (math.sin, ga)))
        y = (ca - cb * cg) / sg
        m = np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * y, c * math.sqrt(1 - cb * cb - y * y)]])

        def score(h):
            u = h @ m
            n = np.linalg.norm(u, axis=1)
            ang = [math.degrees(math.acos(max(-1, min(1, u[i] @ u[j] / n[i] / n[j])))) for i, j in ((1, 2), (0, 2), (0, 1))]
            return np.abs(n - n.mean()).mean() / n.mean() + sum(abs(x - 90) for x in ang) / 270

        best = min(score(h) for flat in itertools.product((-1, 0, 1), repeat=9) if 1 <= round(np.linalg.det(h := np.array(flat).reshape(3, 3))) <= 6)
        x = got[key]
        assert x.score == pytest.approx(best) == pytest.approx(score(np.array(x.rows))) and round(np.linalg.det(np.array(x.rows))) == x.det


def test_quotas_and_alternatives(spark):
    rows = [("a", "top")] * 8 + [("a", "bottom")] * 8 + [("b", "top")] * 9 + [("b", None)] + [("c", None)] + [("d", "top")] + [("d", "bottom")]
    got = {x.key: (x.quota, x.half, x.reason) for x in lattices.balanced_quota(spark.createDataFrame(rows, "key string, side string"), "side", 0.25).collect()}
    assert got == {"a": (4, 2, None), "b": (2, 1, "insufficient"), "c": (0, 0, "no_host"), "d": (0, 0, "insufficient")}
    some = spark.createDataFrame([("a", 1, 4, 0.9, True), ("a", 2, 5, 0.1, True), ("a", 3, 5, 0.9, True), ("b", 1, 5, 0.2, False), ("b", 2, 5, 0.3, False), ("b", 3, 6, 0.9, True)], "key string, at int, layers int, share double, terminated boolean")
    assert {x.key: (x.at, x.exact) for x in lattices.best_alternative(some, 5).collect()} == {"a": (2, True), "b": (2, False)}
    assert {x.key: x.at for x in lattices.best_alternative(some, None).collect()} == {"a": 1, "b": 3}
