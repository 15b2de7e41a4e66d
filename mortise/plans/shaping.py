"""Queries of table shaping, filters, linking and weights, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import linking as lk, shaping as sh
from mortise.plans.statistics import rounded
from mortise.session import table


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """part with two sources of a target, each with gaps."""
    return table(spark, sf, "part").withColumn("excel", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice"))).withColumn("computed", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") + 1))


_T = "(SELECT *, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS excel, CASE WHEN p_size % 2 = 0 THEN p_retailprice + 1 END AS computed FROM part)"


def prefixed_columns(spark: SparkSession, sf: str) -> DataFrame:
    return sh.pick(table(spark, sf, "part"), ["p_partkey", "p_size", "p_colour"], ["p_partkey"], "f_", ["p_partkey"])


def shaped_table(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    return sh.shape(p, {"p_partkey": "long", "p_name": "string", "note": "string", "words": "string"})


def paired_differences(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("F_quantity"), F.max("l_quantity").alias("O_quantity"), F.min("l_linenumber").alias("F_line"), F.count(F.lit(1)).alias("O_other"))
    return sh.differences(l)


def target_choices(spark: SparkSession, sf: str) -> DataFrame:
    modes = ["first_preferred", "second_preferred", "first_only", "second_only"]
    return _targets(spark, sf).select("p_partkey", *(sh.choose("excel", "computed", m).alias(m) for m in modes), F.coalesce(F.nullif(F.trim("p_type"), F.lit("")), F.lit("unknown")).alias("kind"))


def first_existing_column(spark: SparkSession, sf: str) -> DataFrame:
    p = _targets(spark, sf)
    return p.select("p_partkey", sh.first_existing(p, ["target", "excel", "computed"]).alias("target"))


def merged_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return _targets(spark, sf).select("p_partkey", sh.merged_alias(["excel", "computed"], 950.0, 1600.0).alias("target"))


def physical_ranges(spark: SparkSession, sf: str) -> DataFrame:
    bounds = {"ECONOMY": (900.0, 1500.0), "STANDARD": (1000.0, 1400.0)}
    low, high = F.lit(0.0), F.lit(1200.0)
    for kind, (a, b) in bounds.items():
        low, high = F.when(F.col("p_type") == kind, a).otherwise(low), F.when(F.col("p_type") == kind, b).otherwise(high)
    return table(spark, sf, "part").where(F.col("p_retailprice").between(low, high)).select("p_partkey", "p_type", "p_retailprice")


def masked_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("parse_ok", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 4 != 1))
    return c.where(F.coalesce("parse_ok", F.lit(False)) & F.col("c_mktsegment").isNotNull() & (F.abs("c_acctbal") <= 5000)).select("c_custkey", "c_acctbal")


def absolute_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(sh.in_ranges({"l_quantity": (10, 20), "l_discount": (None, 0.05), "l_tax": (0.02, None)})).select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")


def quantile_range_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sh.quantile_range(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], 0.05, 0.95).select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")


def pattern_split(spark: SparkSession, sf: str) -> DataFrame:
    test = F.coalesce(F.col("p_name").rlike("^(small|large) ") | ((F.col("p_size") > 45) & (F.col("p_retailprice") > 1500)), F.lit(False))
    return table(spark, sf, "part").select("p_partkey", F.when(test, "test").otherwise("train").alias("part"))


def substring_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.lower("url").contains("example.com/f")).select("page_id", "url")


def usable_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = _targets(spark, sf).withColumn("empty", F.lit(None).cast("double")).withColumn("rare", F.when(F.col("p_partkey") < 3, F.col("p_size"))).withColumn("same", F.lit(1))
    return rounded(sh.column_report(p, ["excel", "computed", "empty", "rare", "same"]))


def order_statistics_right(spark: SparkSession, sf: str) -> DataFrame:
    stats = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return stats.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "right")


def composite_key_join(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    a = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("target"))
    b = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("target")).where("l_linenumber < 5")
    return lk.composite_join(a, b, ["l_orderkey"], "l_linenumber", "target")


def inner_chain(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    a = l.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_quantity").alias("a"))
    b = l.where("l_returnflag = 'N'").groupBy("l_partkey").agg(F.max("l_quantity").alias("b"))
    t = _targets(spark, sf).select(F.col("p_partkey").alias("l_partkey"), F.coalesce("excel", "computed").alias("target"))
    return a.join(b, "l_partkey").join(t, "l_partkey")


def prediction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lk.wide_predictions(table(spark, sf, "events"), "user_id", "event_type", "value", ["click", "view", "error", "purchase"]), 8)


def grouped_lookup(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")


def key_cascade(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    ids = n.select(F.col("n_name").alias("id")).union(n.select(F.concat(F.lit("old "), "n_name")))
    return lk.cascade(ids, n.where("n_nationkey < 12").select(F.col("n_name").alias("key")))


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lk.pair_scores(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_size", "p_type"], "p_name", {"p_retailprice": 0.25}, 0.75)


def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    out = lk.merge_canonical(table(spark, sf, "lineitem"), ["l_partkey"], [F.col("l_extendedprice"), F.col("l_orderkey")], ["l_orderkey", "l_extendedprice"], ["l_returnflag"])
    return out.withColumn("l_returnflag_all", F.array_join("l_returnflag_all", ","))


def preferred_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    quality = 100 * (F.col("o_orderstatus") == "F").cast("int") + 20 * F.col("o_orderpriority").isNotNull().cast("int") + 5 * F.col("o_orderpriority").startswith("1").cast("int")
    return lk.preferred(o.withColumn("quality", quality), ["o_custkey"], "quality_then_new", F.col("quality"), "o_orderkey")


def statistics_on_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lk.with_statistics(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice"), 5)


def experiment_weights(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_discount").alias("rmse"), F.avg("l_tax").alias("unc"), (F.count(F.lit(1)) / 100).alias("cov"))
    weight = F.exp(-0.9 * F.col("rmse")) * F.exp(-0.25 * F.col("unc")) * F.least(F.greatest("cov", F.lit(0.0)), F.lit(1.0))
    return lk.normalised(l, weight).select("l_suppkey", F.round("weight", 8).alias("weight"))


def weighted_group_prior(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.groupBy("p_brand").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("prior"))


def labelled_top_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_retailprice > 0").select("p_brand", "p_partkey", "p_retailprice")
    return lk.labelled_top(p, "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey")], 3, F.concat("p_brand", F.lit("-T"))).select("p_brand", "p_partkey", "label")


def sweep_audit(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_returnflag", F.explode(F.create_map(F.lit("flat"), F.col("l_quantity") * 1500, F.lit("steep"), F.col("l_quantity") * 1800 - 5000)).alias("column", "predicted"), F.col("l_extendedprice").alias("target"))
    return rounded(lk.audit(l, ["l_returnflag", "column"], "predicted", "target"), 3)


def fold_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    return rounded(l.groupBy("fold", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.avg(F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity"))).alias("mae")), 7)


def global_recentering(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    median = sh.exact_quantiles(o, "o_totalprice", [0.5])[0]
    return o.select("o_orderkey", F.round(F.col("o_totalprice") - F.lit(median) + 1000, 4).alias("centred"))


def domain_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    each = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("std"))
    return rounded(each.crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("total")))).select("c_mktsegment", "n", (F.col("n") / F.col("total")).alias("share"), "mean", "std"), 5)


def filtered_summary(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("l_quantity").between(5, 45)
    value = F.when(ok, F.col("l_extendedprice"))
    return rounded(table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("raw_n"), F.count(value).alias("n"), (F.count(F.lit(1)) - F.count(value)).alias("removed"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")), 4)


def evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("text").rlike("[0-9]")).alias("numeric"))


def qc_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"), F.sum("n_chars").alias("chars"))
    l = table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("quality") == 1).alias("good"))
    return d.crossJoin(l)  # two frames of one row


def duplicate_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "lineitem").groupBy("l_partkey").agg(*(F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")), F.count(F.lit(1)).alias("n")), 5)


def next_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_order")).crossJoin(table(spark, sf, "orders").where("o_orderkey < 0").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_of_none")))


def word_properties(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.explode(F.split("p_name", " ")).alias("word"))
    words = p.groupBy("word").agg(F.avg("p_retailprice").alias("price"))
    return rounded(p.join(words, "word").groupBy("p_partkey").agg(F.avg("price").alias("mean"), F.max("price").alias("highest")), 5)


def candidate_score(spark: SparkSession, sf: str) -> DataFrame:
    error, weight, like = F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity")), F.col("l_tax") + 0.01, F.col("l_quantity") > 25
    each = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg(error).alias("mae"), (F.sum(error * weight) / F.sum(weight)).alias("weighted"), F.avg(F.when(like, error)).alias("alike"), F.abs(F.avg("l_extendedprice") - F.avg(1500 * F.col("l_quantity"))).alias("shift"))
    return each.select("l_returnflag", F.round(0.4 * F.col("mae") + 0.4 * F.col("weighted") + 0.2 * F.coalesce("alike", "mae") + 0.1 * F.col("shift"), 3).alias("score"))


def priority_flags(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    flag = lambda c: c.cast("int")
    urgent, open_, large = flag(F.col("o_orderpriority").startswith("1")), flag(F.col("o_orderstatus") == "O"), flag(F.col("o_totalprice") > 200000)
    return o.select("o_orderkey", urgent.alias("urgent"), open_.alias("open"), large.alias("large"), F.round(0.5 * urgent + 0.3 * open_ + 0.2 * large, 3).alias("score"))


QUERIES = {f.__name__: f for f in (
    prefixed_columns, shaped_table, paired_differences, target_choices, first_existing_column, merged_aliases, physical_ranges, masked_rows, absolute_ranges, quantile_range_rows, pattern_split, substring_rows, usable_columns,
    order_statistics_right, composite_key_join, inner_chain, prediction_coverage, grouped_lookup, key_cascade, pair_scores, canonical_records, preferred_orders, statistics_on_rows, experiment_weights, weighted_group_prior, labelled_top_parts,
    sweep_audit, fold_ensemble, global_recentering, domain_profile, filtered_summary, evidence_counts, qc_summary, duplicate_means, next_ids, word_properties, candidate_score, priority_flags,
)}

_COLUMN = "SELECT '{0}' AS name, count({0}) AS n, round(1 - count({0}) / count(*), 6) AS null_share, count(DISTINCT {0}) AS levels, count({0}) >= 5 AND 1 - count({0}) / count(*) < 0.95 AND count(DISTINCT {0}) >= 2 AS usable FROM t"

ORACLES = {
    "prefixed_columns": "SELECT p_partkey, p_size AS f_p_size FROM part",
    "shaped_table": "SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS note, CAST(to_json(string_split(p_name, ' ')) AS VARCHAR) AS words FROM part",
    "paired_differences": 'SELECT *, "F_quantity" - "O_quantity" AS "D_quantity" FROM (SELECT l_orderkey, min(l_quantity) AS "F_quantity", max(l_quantity) AS "O_quantity", min(l_linenumber) AS "F_line", count(*) AS "O_other" FROM lineitem GROUP BY 1)',
    "target_choices": f"SELECT p_partkey, coalesce(excel, computed) AS first_preferred, coalesce(computed, excel) AS second_preferred, excel AS first_only, computed AS second_only, coalesce(nullif(trim(p_type), ''), 'unknown') AS kind FROM {_T}",
    "first_existing_column": f"SELECT p_partkey, excel AS target FROM {_T}",
    "merged_aliases": f"SELECT p_partkey, CASE WHEN coalesce(excel, computed) BETWEEN 950 AND 1600 THEN coalesce(excel, computed) END AS target FROM {_T}",
    "physical_ranges": "SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_retailprice BETWEEN CASE p_type WHEN 'ECONOMY' THEN 900 WHEN 'STANDARD' THEN 1000 ELSE 0 END AND CASE p_type WHEN 'ECONOMY' THEN 1500 WHEN 'STANDARD' THEN 1400 ELSE 1200 END",
    "masked_rows": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 IN (2, 3) AND c_mktsegment IS NOT NULL AND abs(c_acctbal) <= 5000",
    "absolute_ranges": "SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_tax FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount <= 0.05 AND l_tax >= 0.02",
    "quantile_range_rows": "WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b, quantile_cont(l_quantity, 0.05) AS c, quantile_cont(l_quantity, 0.95) AS d FROM lineitem) SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity FROM lineitem, b WHERE l_extendedprice BETWEEN b.a AND b.b AND l_quantity BETWEEN b.c AND b.d",
    "pattern_split": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(small|large) ') OR (p_size > 45 AND p_retailprice > 1500) THEN 'test' ELSE 'train' END AS part FROM part",
    "substring_rows": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com/f')",
    "usable_columns": f"WITH t AS (SELECT *, CAST(NULL AS DOUBLE) AS empty, CASE WHEN p_partkey < 3 THEN p_size END AS rare, 1 AS same FROM {_T}) " + " UNION ALL ".join(_COLUMN.format(c) for c in ("excel", "computed", "empty", "rare", "same")),
    "order_statistics_right": "SELECT c.c_custkey, n, most, c_mktsegment FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) RIGHT JOIN customer c ON o_custkey = c.c_custkey",
    "composite_key_join": "SELECT a.l_orderkey, a.l_linenumber, a.target, b.other, abs(a.target - b.other) > 1e-6 AS mismatch FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS target FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS other FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2) b USING (l_orderkey, l_linenumber)",
    "inner_chain": f"SELECT a.l_partkey, a, b, coalesce(excel, computed) AS target FROM (SELECT l_partkey, max(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_partkey, max(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b USING (l_partkey) JOIN {_T} t ON t.p_partkey = a.l_partkey",
    "prediction_coverage": "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 8) AS {k}" for k in ("click", "view", "error", "purchase")) + ", round((" + " + ".join(f"CASE WHEN count(value) FILTER (event_type = '{k}') > 0 THEN 1 ELSE 0 END" for k in ("click", "view", "error", "purchase")) + ") / 4, 8) AS coverage FROM events GROUP BY 1",
    "grouped_lookup": "SELECT c_custkey, orders, n FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "key_cascade": "WITH i AS (SELECT n_name AS id FROM nation UNION SELECT 'old ' || n_name FROM nation), k AS (SELECT n_name AS key FROM nation WHERE n_nationkey < 12), m AS (SELECT id, key, CASE WHEN id = key THEN 1 WHEN starts_with(id, key) THEN 2 ELSE 3 END AS r FROM i JOIN k ON contains(id, key)) SELECT id, key, CASE r WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' ELSE 'inside' END AS how FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, length(key) DESC, key) = 1",
    "pair_scores": "SELECT a.p_partkey AS a, b.p_partkey AS b, round(0.75 * len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / least(len(list_distinct(string_split(a.p_name, ' '))), len(list_distinct(string_split(b.p_name, ' ')))) + CASE WHEN a.p_retailprice = b.p_retailprice THEN 0.25 ELSE 0 END, 4) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey",
    "canonical_records": "SELECT l_partkey, count(*) AS n, (max((l_extendedprice, l_orderkey)))[2] AS l_orderkey, max(l_extendedprice) AS l_extendedprice, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag_all FROM lineitem GROUP BY 1",
    "preferred_orders": "WITH q AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, CAST(100 * (o_orderstatus = 'F')::INT + 20 * (o_orderpriority IS NOT NULL)::INT + 5 * starts_with(o_orderpriority, '1')::INT AS INTEGER) AS quality FROM orders) SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY quality DESC, o_orderkey DESC) = 1",
    "statistics_on_rows": "SELECT p_partkey, p_brand, p_retailprice, count(*) OVER w AS n, round(avg(p_retailprice) OVER w, 5) AS mean, round(stddev_samp(p_retailprice) OVER w, 5) AS std, min(p_retailprice) OVER w AS lowest, max(p_retailprice) OVER w AS highest, round(avg(p_retailprice) OVER (), 5) AS all_mean FROM part WINDOW w AS (PARTITION BY p_brand)",
    "experiment_weights": "WITH s AS (SELECT l_suppkey, exp(-0.9 * stddev_samp(l_discount)) * exp(-0.25 * avg(l_tax)) * least(greatest(count(*) / 100, 0), 1) AS w FROM lineitem GROUP BY 1) SELECT l_suppkey, round(coalesce(w, 0) / sum(w) OVER (), 8) AS weight FROM s",
    "weighted_group_prior": "SELECT p_brand, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS prior FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "labelled_top_parts": "SELECT p_brand, p_partkey, p_brand || '-T' || k AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_retailprice > 0) WHERE k <= 3",
    "sweep_audit": 'WITH x AS (SELECT l_returnflag, \'flat\' AS "column", l_quantity * 1500 - l_extendedprice AS e FROM lineitem UNION ALL SELECT l_returnflag, \'steep\', l_quantity * 1800 - 5000 - l_extendedprice FROM lineitem), m AS (SELECT l_returnflag, "column", count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM x GROUP BY 1, 2) SELECT l_returnflag, "column", n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(bias, 3) AS bias, row_number() OVER (ORDER BY mae, rmse, l_returnflag, "column") = 1 AS best FROM m',
    "fold_ensemble": "SELECT l_orderkey % 5 AS fold, l_partkey, count(*) AS n, round(avg(l_quantity), 7) AS mean, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 7) AS mae FROM lineitem GROUP BY 1, 2",
    "global_recentering": "SELECT o_orderkey, round(o_totalprice - (SELECT median(o_totalprice) FROM orders) + 1000, 4) AS centred FROM orders",
    "domain_profile": "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 5) AS share, round(avg(c_acctbal), 5) AS mean, round(stddev_samp(c_acctbal), 5) AS std FROM customer GROUP BY 1",
    "filtered_summary": "SELECT l_linestatus, count(*) AS raw_n, count(v) AS n, count(*) - count(v) AS removed, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM (SELECT l_linestatus, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1",
    "evidence_counts": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(text, '[0-9]')) AS numeric FROM conversations GROUP BY 1",
    "qc_summary": "SELECT * FROM (SELECT count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS empty, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents), (SELECT count(*) AS labels, count(*) FILTER (quality = 1) AS good FROM labels)",
    "duplicate_means": "SELECT l_partkey, round(avg(l_quantity), 5) AS l_quantity, round(avg(l_discount), 5) AS l_discount, round(avg(l_tax), 5) AS l_tax, count(*) AS n FROM lineitem GROUP BY 1",
    "next_ids": "SELECT coalesce(max(o_orderkey), 0) + 1 AS next_order, CAST(1 AS BIGINT) AS next_of_none FROM orders",
    "word_properties": "WITH w AS (SELECT p_partkey, p_retailprice, unnest(string_split(p_name, ' ')) AS word FROM part), a AS (SELECT word, avg(p_retailprice) AS price FROM w GROUP BY 1) SELECT p_partkey, round(avg(price), 5) AS mean, round(max(price), 5) AS highest FROM w JOIN a USING (word) GROUP BY 1",
    "candidate_score": "SELECT l_returnflag, round(0.4 * avg(e) + 0.4 * sum(e * w) / sum(w) + 0.2 * coalesce(avg(e) FILTER (l_quantity > 25), avg(e)) + 0.1 * abs(avg(l_extendedprice) - avg(1500 * l_quantity)), 3) AS score FROM (SELECT *, abs(l_extendedprice - 1500 * l_quantity) AS e, l_tax + 0.01 AS w FROM lineitem) GROUP BY 1",
    "priority_flags": "SELECT o_orderkey, u AS urgent, o AS open, l AS large, round(CAST(0.5 * u + 0.3 * o + 0.2 * l AS DOUBLE), 3) AS score FROM (SELECT o_orderkey, starts_with(o_orderpriority, '1')::INT AS u, (o_orderstatus = 'O')::INT AS o, (o_totalprice > 200000)::INT AS l FROM orders)",
}
