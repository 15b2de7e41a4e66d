"""Statistics queries and their SQL twins. Reals are rounded, as engines add in different orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mortise.operators import statistics as st
from mortise.operators.ranks import with_quantiles
from mortise.operators.shaping import exact_quantiles
from mortise.session import table

R = 6


def rounded(df: DataFrame, places: int = R) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def group_summary_delta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.group_summary(table(spark, sf, "documents"), ["source", "lang"], "n_chars", 2))


def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.stddev_samp("quality").alias("quality_std")))


def interaction_table(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    sums = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_price"), F.sum("l_quantity").alias("sum_qty")).where("n >= 5")
    return rounded(with_quantiles(sums, l, keys, "l_extendedprice", {"median_price": 0.5}), 4)


def interaction_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy("p_brand").pivot("p_size", [1, 10, 20, 30, 40, 50]).agg(F.avg("p_retailprice"))
    return rounded(p.select("p_brand", *(F.col(str(k)).alias(f"size_{k}") for k in (1, 10, 20, 30, 40, 50))))


def category_effect(spark: SparkSession, sf: str) -> DataFrame:
    out = st.group_summary(table(spark, sf, "part"), ["p_type"], "p_retailprice", 3)
    w = Window.orderBy(F.col("n").desc(), "p_type")
    # grouped rows only: as many as there are types
    return rounded(out.withColumn("place", F.row_number().over(w)).where("place <= 25").select("p_type", "n", "median", "q1", "q3", "delta"))


def corr_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ("l_quantity", "l_discount", "l_tax")
    l = table(spark, sf, "lineitem").agg(*(F.corr(c, "l_extendedprice").alias(c) for c in names), F.count(F.lit(1)).alias("n"))
    return rounded(l.unpivot(["n"], list(names), "feature", "r"), 5)


def effect_high_low(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    a, b = exact_quantiles(l, "l_quantity", [0.25, 0.75])
    low, high = (exact_quantiles(l.where(c), "l_extendedprice", [0.5])[0] for c in (F.col("l_quantity") <= a, (F.col("l_quantity") >= b) & (F.col("l_quantity") > a)))
    m = l.agg(F.lit(high).cast("double").alias("median_high"), F.lit(low).cast("double").alias("median_low"), F.stddev_pop("l_extendedprice").alias("sd"))
    return rounded(m.select("median_high", "median_low", (F.col("median_high") - F.col("median_low")).alias("effect"), F.try_divide(F.col("median_high") - F.col("median_low"), "sd").alias("effect_sd")), 4)


def cliffs_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(st.cliffs_delta(d, "quality", "n_chars"))


def binned_response(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select((F.floor((F.col("l_quantity") - 1) / 10)).cast("long").alias("bin"), "l_extendedprice")
    many = l.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rounded(with_quantiles(many, l, ["bin"], "l_extendedprice", {"median": 0.5, "q1": 0.25, "q3": 0.75}), 4)


def outlier_flags(spark: SparkSession, sf: str) -> DataFrame:
    o = st.outliers(table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), "n_chars")
    return rounded(o.where("iqr_out or mad_out"), 4)


def smd_report(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    a = l.agg(*(f(c).alias(f"{n}_{c}") for c in ("l_quantity", "l_extendedprice", "l_discount") for n, f in (("s", lambda c: F.avg(F.when(F.col("l_returnflag") == "A", F.col(c)))), ("t", lambda c: F.avg(F.when(F.col("l_returnflag") == "R", F.col(c)))), ("d", lambda c: F.stddev_samp(F.when(F.col("l_returnflag") == "A", F.col(c)))))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(f"t_{c}") - F.col(f"s_{c}"), F.col(f"d_{c}")).alias("smd")) for c in ("l_quantity", "l_extendedprice", "l_discount"))))
    return rounded(a.select(rows.alias("r")).select("r.*"), 5)


def metrics_overall_by_group(spark: SparkSession, sf: str) -> DataFrame:
    j = predictions(spark, sf)
    out = j.groupingSets([["p_brand"], []], "p_brand").agg(*st.metrics("target", "pred"))
    return rounded(out.withColumn("p_brand", F.coalesce("p_brand", F.lit("ALL"))), 4)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """id, run, pred, target, p_brand, p_type: lineitem as prediction runs of part."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 4).alias("run"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("pred"), "l_orderkey", "l_linenumber", "l_shipdate")
    return l.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("target"), "p_brand", "p_type"), "id")


def rank_average(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    ranked = p.withColumn("rank", st.average_rank(["p_brand"], "p_size"))
    return rounded(ranked.withColumn("pct", F.col("rank") / F.count(F.lit(1)).over(Window.partitionBy("p_brand"))))


QUERIES = {f.__name__: f for f in (group_summary_delta, target_summary, interaction_table, interaction_pivot, category_effect, corr_features, effect_high_low, cliffs_delta, binned_response, outlier_flags, smd_report, metrics_overall_by_group, rank_average)}

_PRED = "SELECT l_partkey AS id, l_suppkey % 4 AS run, l_extendedprice / l_quantity AS pred, p_retailprice AS target, p_brand, p_type, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey"
ORACLES = {
    "group_summary_delta": """
      WITH k AS (SELECT coalesce(nullif(trim(source), ''), 'unknown') AS source, coalesce(nullif(trim(lang), ''), 'unknown') AS lang, n_chars FROM documents WHERE n_chars IS NOT NULL)
      SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(stddev_samp(n_chars), 6) AS std, round(quantile_cont(n_chars, 0.25), 6) AS q1,
        round(quantile_cont(n_chars, 0.75), 6) AS q3, min(n_chars) AS low, max(n_chars) AS high, round(quantile_cont(n_chars, 0.5) - (SELECT quantile_cont(n_chars, 0.5) FROM k), 6) AS delta
      FROM k GROUP BY 1, 2 HAVING count(*) >= 2""",
    "target_summary": "SELECT lang, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(stddev_samp(quality), 6) AS quality_std FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "interaction_table": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, round(sum(l_quantity), 4) AS sum_qty FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5",
    "interaction_pivot": "SELECT p_brand, " + ", ".join(f"round(avg(p_retailprice) FILTER (WHERE p_size = {k}), 6) AS size_{k}" for k in (1, 10, 20, 30, 40, 50)) + " FROM part GROUP BY 1",
    "category_effect": """SELECT coalesce(nullif(trim(p_type), ''), 'unknown') AS p_type, count(p_retailprice) AS n, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.25), 6) AS q1,
      round(quantile_cont(p_retailprice, 0.75), 6) AS q3, round(quantile_cont(p_retailprice, 0.5) - (SELECT quantile_cont(p_retailprice, 0.5) FROM part), 6) AS delta
      FROM part GROUP BY 1 HAVING count(p_retailprice) >= 3 ORDER BY n DESC, p_type LIMIT 25""",
    "corr_features": " UNION ALL ".join(f"SELECT count(*) AS n, '{c}' AS feature, round(corr({c}, l_extendedprice), 5) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "effect_high_low": """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem),
      m AS (SELECT quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity >= b) AS h, quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity <= a) AS l, stddev_pop(l_extendedprice) AS sd FROM lineitem, q)
      SELECT round(h, 4) AS median_high, round(l, 4) AS median_low, round(h - l, 4) AS effect, round((h - l) / sd, 4) AS effect_sd FROM m""",
    "cliffs_delta": """WITH d AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT n_chars AS v, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM d GROUP BY 1),
      x AS (SELECT a, b, sum(b) OVER (ORDER BY v) - b AS below FROM c)
      SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n0, round(CAST(2 * sum(a * below) + sum(a * b) - sum(a) * sum(b) AS DOUBLE) / (sum(a) * sum(b)), 6) AS delta FROM x""",
    "binned_response": "SELECT CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
    "outlier_flags": """WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents), q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM d),
      m AS (SELECT quantile_cont(abs(n_chars - q2), 0.5) AS mad FROM d, q),
      z AS (SELECT doc_id, n_chars, n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) AS iqr_out, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (n_chars - q2) / mad END AS z FROM d, q, m)
      SELECT doc_id, n_chars, iqr_out, round(z, 4) AS mad_z, abs(z) > 3.5 AS mad_out FROM z WHERE iqr_out OR abs(z) > 3.5""",
    "smd_report": " UNION ALL ".join(f"SELECT '{c}' AS feature, round((avg({c}) FILTER (WHERE l_returnflag = 'R') - avg({c}) FILTER (WHERE l_returnflag = 'A')) / stddev_samp({c}) FILTER (WHERE l_returnflag = 'A'), 5) AS smd FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "metrics_overall_by_group": f"""WITH j AS ({_PRED}) SELECT coalesce(p_brand, 'ALL') AS p_brand, count(*) AS n, round(avg(abs(pred - target)), 4) AS mae, round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse,
      round(1 - sum((pred - target) * (pred - target)) / nullif(var_pop(target) * count(*), 0), 4) AS r2, round(corr(target, pred), 4) AS pearson, round(avg(pred - target), 4) AS bias FROM j GROUP BY GROUPING SETS ((p_brand), ())""",
    "rank_average": """WITH r AS (SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
      SELECT p_partkey, p_brand, p_size, CAST(rank AS DOUBLE) AS rank, round(rank / n, 6) AS pct FROM r""",
}
