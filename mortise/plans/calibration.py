"""Calibration, weighting and evaluation queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import calibration as ca, statistics as st
from mortise.plans.statistics import _PRED, predictions, rounded
from mortise.operators.ranks import group_quantiles
from mortise.operators.shaping import exact_quantiles
from mortise.session import table


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """id, p_brand, p_type, target and the mean predictions a and b of two runs: one row a part that has both."""
    p = predictions(spark, sf).where("run < 2").groupBy("id", "p_brand", "p_type", "target").pivot("run", [0, 1]).agg(F.avg("pred"))
    return p.select("id", "p_brand", "p_type", "target", F.col("0").alias("a"), F.col("1").alias("b")).where("a is not null and b is not null")


def target_encoding_oof(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_partkey") % 5).alias("fold"), "p_retailprice")
    return rounded(ca.target_encoding(p, "p_type", "fold", "p_retailprice").select("p_partkey", "encoded"), 4)


def affine_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ca.affine(_runs(spark, sf), "p_brand", "a", "target").select("id", "calibrated"), 3)


def shrunken_offset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ca.shrunken_offset(_runs(spark, sf), "p_brand", "a", "target", 8.0, 500.0).select("id", "calibrated"), 3)


def ridge_blend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ca.ridge_blend(_runs(spark, sf), "target", "a", "b"), 6)


def multi_level_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    train = p.where("p_partkey % 3 = 0")  # the labelled share, a property of the query, over the whole table
    return rounded(ca.multi_level(p.drop("p_retailprice"), train, [(["p_brand", "p_type"], 0.5), (["p_type"], 0.3), (["p_size"], 0.2)], "p_retailprice").select("p_partkey", "looked_up"), 4)


def inverse_frequency_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return rounded(ca.inverse_frequency(d, ["source", "lang"]).select("doc_id", "weight"), 6)


def capped_inverse_weights(spark: SparkSession, sf: str) -> DataFrame:
    runs = predictions(spark, sf).groupBy("p_brand", "p_type", "run").agg((F.avg(F.abs(F.col("pred") - F.col("target"))) / 1000).alias("score"))
    return rounded(ca.capped_inverse_weights(runs, "score").select("p_brand", "p_type", "run", "weight"), 6)


def guarded_blend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_runs(spark, sf).select("id", ca.guarded_blend("a", "b", 0.35, 400.0).alias("balanced"), ca.guarded_blend("a", "b", 0.55, 400.0).alias("trend")), 4)


def rank_z_map(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return rounded(ca.rank_z_map(p, "p_brand", "p_size", "p_retailprice", st.average_rank(["p_brand"], "p_size")).select("p_partkey", "mapped"), 4)


def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return ca.stratified_holdout(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 0.2)


def classifier_measures(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(ca.classification(d, ["lang"], F.col("quality"), (F.col("n_chars") >= 400).cast("int")), 6)


def leave_one_group_out(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's error under the offset of all other brands: sums over all less the brand's own."""
    j = predictions(spark, sf)
    own = j.groupBy("p_brand").agg(F.sum(F.col("target") - F.col("pred")).alias("s"), F.count(F.lit(1)).alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    shift = own.crossJoin(F.broadcast(total)).where("tn - n >= 5").select("p_brand", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("shift"))
    return rounded(j.join(shift, "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.first("shift").alias("shift"), F.avg(F.abs(F.col("target") - F.col("pred") - F.col("shift"))).alias("mae")), 3)


def spearman_by_group(spark: SparkSession, sf: str) -> DataFrame:
    r = _runs(spark, sf).select("p_brand", st.average_rank(["p_brand"], "target").alias("rt"), st.average_rank(["p_brand"], "a").alias("ra"))
    return rounded(r.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.corr("rt", "ra").alias("spearman")), 5)


def error_by_group_and_method(spark: SparkSession, sf: str) -> DataFrame:
    e = _runs(spark, sf).unpivot(["p_type", "target"], ["a", "b"], "method", "pred")
    return rounded(e.groupBy("p_type", "method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae")), 4)


def quantile_table(spark: SparkSession, sf: str) -> DataFrame:
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    return rounded(group_quantiles(table(spark, sf, "part"), ["p_type"], "p_retailprice", {f"q{int(p * 100):02d}": p for p in at}), 4)


def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Five bins between the distinct quantiles of all prices: right-closed, the first including its lower edge."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    edges = F.array_distinct(F.array(*(F.lit(q).cast("double") for q in exact_quantiles(p, "p_retailprice", [i / 5 for i in range(6)]))))
    below = F.greatest(F.size(F.filter(edges, lambda v: v < F.col("p_retailprice"))) - 1, F.lit(0))
    return p.groupBy(below.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


QUERIES = {f.__name__: f for f in (
    target_encoding_oof, affine_by_group, shrunken_offset, ridge_blend, multi_level_lookup, inverse_frequency_weights, capped_inverse_weights, guarded_blend, rank_z_map, stratified_holdout,
    classifier_measures, leave_one_group_out, spearman_by_group, error_by_group_and_method, quantile_table, quantile_bins)}
_RUNS = f"SELECT * FROM (SELECT id, p_brand, p_type, target, avg(pred) FILTER (WHERE run = 0) AS a, avg(pred) FILTER (WHERE run = 1) AS b FROM ({_PRED}) GROUP BY 1, 2, 3, 4) WHERE a IS NOT NULL AND b IS NOT NULL"
_MEASURES = """SELECT lang, tp, fp, fn, tn, round((tp + tn) / nullif(n, 0), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 6) AS mcc, round((n * (tp + tn) - e) / nullif(n * n - e, 0), 6) AS kappa FROM (SELECT *, tp + fp + fn + tn AS n, (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) AS e FROM c)"""
ORACLES = {
    "target_encoding_oof": """WITH p AS (SELECT p_partkey, p_type, p_partkey % 5 AS fold, p_retailprice AS y FROM part),
      w AS (SELECT *, sum(y) OVER (PARTITION BY p_type) - sum(y) OVER (PARTITION BY p_type, fold) AS s, count(y) OVER (PARTITION BY p_type) - count(y) OVER (PARTITION BY p_type, fold) AS n,
        sum(y) OVER () - sum(y) OVER (PARTITION BY fold) AS fs, count(y) OVER () - count(y) OVER (PARTITION BY fold) AS fn FROM p)
      SELECT p_partkey, round(coalesce(s / nullif(n, 0), fs / nullif(fn, 0)), 4) AS encoded FROM w""",
    "affine_by_group": f"WITH r AS ({_RUNS}), f AS (SELECT p_brand, regr_slope(target, a) AS b, regr_intercept(target, a) AS i, regr_count(target, a) AS n FROM r GROUP BY 1) SELECT id, round(CASE WHEN f.n >= 5 THEN coalesce(f.i + f.b * a, a) ELSE a END, 3) AS calibrated FROM r JOIN f ON f.p_brand = r.p_brand",
    "shrunken_offset": f"WITH r AS ({_RUNS}), f AS (SELECT p_brand, quantile_cont(target - a, 0.5) AS m, count(*) AS n FROM r GROUP BY 1) SELECT id, round(a + least(greatest(m, -500), 500) * n / (n + 8.0::DOUBLE), 3) AS calibrated FROM r JOIN f ON f.p_brand = r.p_brand",
    "ridge_blend": f"WITH r AS ({_RUNS}), s AS (SELECT count(*) AS n, sum(a * a) + 1 AS a, sum(a * b) AS b, sum(b * b) + 1 AS d, sum(a * target) AS u, sum(b * target) AS v FROM r) SELECT n, round((d * u - b * v) / (a * d - b * b), 6) AS w1, round((a * v - b * u) / (a * d - b * b), 6) AS w2 FROM s",
    "multi_level_lookup": """WITH t AS (SELECT * FROM part WHERE p_partkey % 3 = 0), a AS (SELECT p_brand, p_type, quantile_cont(p_retailprice, 0.5) AS m, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS m, count(*) AS n FROM t GROUP BY 1),
      c AS (SELECT p_size, quantile_cont(p_retailprice, 0.5) AS m, count(*) AS n FROM t GROUP BY 1),
      w AS (SELECT p_partkey, a.m AS am, b.m AS bm, c.m AS cm, 0.5::DOUBLE * coalesce(least(1, a.n / 10.0::DOUBLE), 0) AS aw, 0.3::DOUBLE * coalesce(least(1, b.n / 10.0::DOUBLE), 0) AS bw, 0.2::DOUBLE * coalesce(least(1, c.n / 10.0::DOUBLE), 0) AS cw
        FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_type = p.p_type LEFT JOIN b ON b.p_type = p.p_type LEFT JOIN c ON c.p_size = p.p_size)
      SELECT p_partkey, round((aw * coalesce(am, 0) + bw * coalesce(bm, 0) + cw * coalesce(cm, 0) + 0.08::DOUBLE * (SELECT quantile_cont(p_retailprice, 0.5) FROM t)) / (aw + bw + cw + 0.08::DOUBLE), 4) AS looked_up FROM w""",
    "inverse_frequency_weights": "WITH n AS (SELECT doc_id, pow(1.0 / count(*) OVER (PARTITION BY source, lang), 0.5) AS w FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT doc_id, round(w / avg(w) OVER (), 6) AS weight FROM n",
    "capped_inverse_weights": f"""WITH r AS (SELECT p_brand, p_type, run, avg(abs(pred - target)) / 1000 AS s FROM ({_PRED}) GROUP BY 1, 2, 3), w AS (SELECT *, 1.0 / greatest(s - (SELECT min(s) FROM r) + 0.05::DOUBLE, 0.05::DOUBLE) AS w FROM r),
      c AS (SELECT *, least(w, (SELECT quantile_cont(w, 0.9) FROM w)) AS c FROM w) SELECT p_brand, p_type, run, round(c / sum(c) OVER (), 6) AS weight FROM c""",
    "guarded_blend": f"WITH r AS ({_RUNS}) SELECT id, round(a + 0.35::DOUBLE * greatest(least(b - a, 400), -400), 4) AS balanced, round(a + 0.55::DOUBLE * greatest(least(b - a, 400), -400), 4) AS trend FROM r",
    "rank_z_map": """WITH r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r FROM part), g AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(r) AS rm, stddev_pop(r) AS rs FROM r GROUP BY 1)
      SELECT p_partkey, round(m + s * coalesce((r - rm) / nullif(rs, 0), 0), 4) AS mapped FROM r JOIN g ON g.p_brand = r.p_brand""",
    "stratified_holdout": """WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
      SELECT p_partkey, p_brand, k <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, least(CAST(round(n * 0.2::DOUBLE) AS BIGINT), n - 1)) END AS held_out FROM r""",
    "classifier_measures": f"""WITH d AS (SELECT lang, quality AS y, CAST(n_chars >= 400 AS INT) AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
      c AS (SELECT lang, count(*) FILTER (WHERE y = 1 AND s = 1) AS tp, count(*) FILTER (WHERE y = 0 AND s = 1) AS fp, count(*) FILTER (WHERE y = 1 AND s = 0) AS fn, count(*) FILTER (WHERE y = 0 AND s = 0) AS tn FROM d GROUP BY 1) {_MEASURES}""",
    "leave_one_group_out": f"""WITH j AS ({_PRED}), o AS (SELECT p_brand, sum(target - pred) AS s, count(*) AS n FROM j GROUP BY 1), f AS (SELECT p_brand, ((SELECT sum(s) FROM o) - s) / ((SELECT sum(n) FROM o) - n) AS sh FROM o)
      SELECT j.p_brand, count(*) AS n, round(first(sh), 3) AS shift, round(avg(abs(target - pred - sh)), 3) AS mae FROM j JOIN f ON f.p_brand = j.p_brand GROUP BY 1""",
    "spearman_by_group": f"""WITH r AS ({_RUNS}), k AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY target) + (count(*) OVER (PARTITION BY p_brand, target) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY p_brand ORDER BY a) + (count(*) OVER (PARTITION BY p_brand, a) - 1) / 2.0 AS ra FROM r)
      SELECT p_brand, count(*) AS n, round(corr(rt, ra), 5) AS spearman FROM k GROUP BY 1""",
    "error_by_group_and_method": f"WITH r AS ({_RUNS}), e AS (SELECT p_type, 'a' AS method, abs(a - target) AS e FROM r UNION ALL SELECT p_type, 'b', abs(b - target) FROM r) SELECT p_type, method, count(*) AS n, round(avg(e), 4) AS mae FROM e GROUP BY 1, 2",
    "quantile_table": "SELECT p_type, " + ", ".join(f"round(quantile_cont(p_retailprice, {p}), 4) AS q{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM part GROUP BY 1",
    "quantile_bins": """WITH e AS (SELECT list_distinct(quantile_cont(p_retailprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM part), b AS (SELECT greatest(len(list_filter((SELECT e FROM e), lambda v: v < p_retailprice)) - 1, 0) AS bin, p_retailprice AS p FROM part)
      SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, min(p) AS low, max(p) AS high FROM b GROUP BY 1""",
}
