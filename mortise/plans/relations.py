"""Facet, join, dedup, text and retrieval queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import relations as rl, texts as tx
from mortise.plans.statistics import rounded
from mortise.session import table
from mortise.streaming import events as ev

CUES = {"licence": "(?i)licen[cs]e", "mail": "@", "number": "[0-9]{4,}"}


def facet_count_source_lang(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def facet_multivalue_topk(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("area")).where("trim(area) <> ''").groupBy("area").count()
    top = words.orderBy(F.col("count").desc(), "area").limit(7)  # the feature: seven areas and the others
    others = words.join(top.select("area"), "area", "left_anti").agg(F.lit("Others").alias("area"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return top.union(others).withColumnRenamed("count", "n")


def year_series_dense(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return rounded(rl.dense_series(o, "year", {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")}), 2)


def left_enrich(spark: SparkSession, sf: str) -> DataFrame:
    latest = [F.col("o_orderdate").desc(), F.col("o_orderkey")]
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate", "o_orderpriority")
    return rl.left_enrich(c, o, "key", latest).select("key", "c_name", "o_orderkey", "o_orderpriority")


def full_outer_keys(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("d")), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l"))
    return d.join(l, "doc_id", "full_outer").select("doc_id", F.col("d").isNotNull().alias("in_documents"), F.col("l").isNotNull().alias("in_labels"))


def semi_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")


def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return rl.first_of(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id").desc()])


def cap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return rl.top_of(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


def prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tx.prefix_budget(table(spark, sf, "conversations"), "conv_id", "text", [F.col("turn")], 600).select("conv_id", "turn", "used")


def best_match_margin(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    n = lines.count()
    l = rl.dealt(lines, n, "l_orderkey").join(rl.dealt(orders, n, "l_orderkey"), "l_orderkey")
    pairs = l.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") / F.col("o_totalprice"), 6).alias("score"))
    pairs = pairs.groupBy("l_orderkey", "l_partkey").agg(F.max("score").alias("score"))
    return rl.best_match(pairs, "l_orderkey", "l_partkey", "score")


def repair_fill(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    by = d.groupBy("source").agg(F.max("quality").alias("q"))
    repaired = F.filter(F.array(F.when(F.col("quality").isNull() & F.col("q").isNotNull(), F.lit("quality"))), lambda x: x.isNotNull())
    return d.join(by, "source").select("doc_id", F.coalesce("quality", "q").alias("quality"), F.array_join(repaired, ",").alias("repaired"))


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = tx.chunk_windows(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "ordinal", "start", F.char_length("piece").cast("long").alias("n"), F.md5("piece").alias("digest"))


def cue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tx.cue_counts(table(spark, sf, "documents"), "source", "text", CUES)


def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tx.tfidf_cosine(table(spark, sf, "documents"), "doc_id", "text", "the moron and shonti licensed apache"))


def unit_to_ev(spark: SparkSession, sf: str) -> DataFrame:
    units = F.element_at(F.array(*(F.lit(u) for u in ("eV", "meV", "kJ/mol", "kcal/mol", "J/mol", "au"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", tx.to_ev(F.col("value"), units).alias("ev"))


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.avg("k").alias("mean")))


def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


def intersect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf, "part").where("p_size > 25").select("p_partkey"))


def except_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


def alpaca_export(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    a, b = c.where("role = 'user'"), c.where("role = 'assistant'").select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("text").alias("output"))
    j = a.join(b, (F.col("conv_id") == F.col("c2")) & (F.col("turn") + 1 == F.col("t2"))).where("trim(text) <> '' and trim(output) <> ''")
    return j.select("conv_id", "turn", F.md5(F.concat_ws("|", "text", "output")).alias("digest"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return rounded(rl.cosine_topk(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5))  # queries: ids divisible by 50, against all rows


def processed_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.tumbling(table(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), 4)


def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return p.select("p_brand", "n", (F.conv(F.substring(F.md5("p_brand"), 1, 8), 16, 10).cast("long") % 5).alias("fold"))


QUERIES = {f.__name__: f for f in (
    facet_count_source_lang, facet_multivalue_topk, year_series_dense, left_enrich, full_outer_keys, semi_gate, anti_missing, dedup_keep_last, cap_per_group, prefix_budget, best_match_margin, repair_fill, chunk_windows,
    cue_counts, tfidf_cosine, unit_to_ev, json_fields, union_distinct, intersect_keys, except_keys, alpaca_export, vector_topk, processed_anti_join, events_tumbling, group_folds)}
ORACLES = {
    "facet_count_source_lang": "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2",
    "facet_multivalue_topk": """WITH w AS (SELECT area, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS area FROM part) WHERE trim(area) <> '' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, area) AS k FROM w)
      SELECT area, n FROM r WHERE k <= 7 UNION ALL SELECT 'Others', CAST(coalesce(sum(n), 0) AS BIGINT) FROM r WHERE k > 7""",
    "year_series_dense": """WITH o AS (SELECT year(o_orderdate) AS y, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1)
      SELECT CAST(y.y AS INT) AS year, coalesce(n, 0) AS n, round(coalesce(t, 0), 2) AS total FROM (SELECT unnest(range((SELECT min(y) FROM o), (SELECT max(y) FROM o) + 1)) AS y) y LEFT JOIN o ON o.y = y.y""",
    "left_enrich": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT c_custkey AS key, c_name, o_orderkey, o_orderpriority FROM customer LEFT JOIN o ON o_custkey = c_custkey AND k = 1""",
    "full_outer_keys": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_documents, l.doc_id IS NOT NULL AS in_labels FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "semi_gate": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
    "anti_missing": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "dedup_keep_last": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "cap_per_group": "SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "prefix_budget": "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 600",
    "best_match_margin": """WITH p AS (SELECT l_orderkey, l_partkey, max(round(l_extendedprice / o_totalprice, 6)) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey))
      SELECT l_orderkey, l_partkey, score, least(greatest(score, 0.55), 0.78) AS confidence FROM r WHERE k = 1 AND score >= 0.26 AND (score - coalesce(nxt, 0) >= 0.04 OR score >= 0.45)""",
    "repair_fill": "WITH d AS (SELECT d.doc_id, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), b AS (SELECT source, max(quality) AS q FROM d GROUP BY 1) SELECT doc_id, coalesce(quality, q) AS quality, CASE WHEN quality IS NULL AND q IS NOT NULL THEN 'quality' ELSE '' END AS repaired FROM d JOIN b ON d.source = b.source",
    "chunk_windows": """WITH t AS (SELECT doc_id, text, CASE WHEN length(text) <= 3600 THEN 1 ELSE CAST(ceil((length(text) - 3600) / 3300.0) AS BIGINT) + 1 END AS c FROM documents WHERE length(text) > 0),
      p AS (SELECT doc_id, k AS ordinal, k * 3300 AS start, substring(text, CAST(k * 3300 + 1 AS BIGINT), 3600) AS piece FROM (SELECT doc_id, text, unnest(range(c)) AS k FROM t))
      SELECT doc_id, ordinal, start, length(piece) AS n, md5(piece) AS digest FROM p WHERE length(piece) >= 30""",
    "cue_counts": "SELECT source, count(*) FILTER (WHERE regexp_matches(text, '(?i)licen[cs]e')) AS cue_licence, count(*) FILTER (WHERE contains(text, '@')) AS cue_mail, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{4,}')) AS cue_number FROM documents GROUP BY 1",
    "tfidf_cosine": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2),
      idf AS (SELECT w, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY 1),
      q AS (SELECT w, count(*) AS c FROM (SELECT unnest(string_split('the moron and shonti licensed apache', ' ')) AS w) GROUP BY 1), qw AS (SELECT q.w, c * idf AS x FROM q JOIN idf ON q.w = idf.w), qn AS (SELECT w, x / sqrt((SELECT sum(x * x) FROM qw)) AS x FROM qw)
      SELECT doc_id, round(sum(tf * idf * coalesce(qn.x, 0)) / sqrt(sum(tf * idf * tf * idf)), 6) AS cosine FROM tf JOIN idf ON tf.w = idf.w LEFT JOIN qn ON qn.w = tf.w GROUP BY 1 HAVING sum(tf * idf * coalesce(qn.x, 0)) > 0""",
    "unit_to_ev": "SELECT event_id, round(CASE event_id % 6 WHEN 1 THEN value * (1 / 1000) WHEN 2 THEN value * (1 / CAST(96.4853321233 AS DOUBLE)) WHEN 3 THEN value * (1 / CAST(23.0605478306 AS DOUBLE)) WHEN 4 THEN value * (1 / CAST(96485.3321233 AS DOUBLE)) ELSE value END, 6) AS ev FROM events",
    "json_fields": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, round(avg(k), 6) AS mean FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_keys": "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25",
    "except_keys": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "alpaca_export": "SELECT a.conv_id, a.turn, md5(a.text || '|' || b.text) AS digest FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant' AND trim(a.text) <> '' AND trim(b.text) <> ''",
    "vector_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS q_id, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS c FROM v, v q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
      SELECT q_id, vec_id, round(c, 6) AS cosine, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, vec_id) AS place FROM p) WHERE place <= 5""",
    "processed_anti_join": "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "group_folds": "SELECT p_brand, count(*) AS n, CAST(concat('0x', substring(md5(p_brand), 1, 8)) AS BIGINT) % 5 AS fold FROM part GROUP BY 1",
}
