"""Retrieval, model and event-time queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import relations as rl, retrieval as rt
from mortise.plans.statistics import rounded
from mortise.session import table
from mortise.streaming import events as ev


def knn_estimate(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double"))
    return rounded(rt.knn_mean(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", "y"), 5)  # queries: ids divisible by 50, against all rows


def hybrid_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Of each asked vector, rows near it and rows with its label (scored by closeness of id), merged."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    near = rl.cosine_topk(v, asked, "vec_id", "embedding", 10).select("q_id", "vec_id", F.round("cosine", 6).alias("score"))
    # rows of a label are ranked by id, and a query takes the ten that follow it: an equi-join on label and a position
    place = F.row_number().over(rt.Window.partitionBy("label").orderBy("vec_id"))
    ranked = v.select("vec_id", "label", place.alias("r"))
    want = ranked.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "label", F.explode(F.sequence(F.col("r") + 1, F.col("r") + 10)).alias("r"))
    same = want.join(ranked, ["label", "r"]).select("q_id", "vec_id", F.round(1.0 / (1 + F.abs(F.col("vec_id") - F.col("q_id"))), 6).alias("score"))
    return rt.hybrid(near, same, "q_id", "vec_id", "score", 8)


def quality_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of documents learnt from length, source and language on four fifths, given for all; no twin, the model is fitted."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rounded(rt.label_model(d.where("doc_id % 5 > 0"), d, ["n_chars"], ["source", "lang"], "quality").select("doc_id", "probability"))


def group_zscores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rt.zscores(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice"), 5)


def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.sliding(table(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), 4)


def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.sessions(table(spark, sf, "events"), "2 hours")
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


QUERIES = {f.__name__: f for f in (knn_estimate, hybrid_retrieval, quality_probability, group_zscores, events_sliding, events_sessions)}
ORACLES = {
    "knn_estimate": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT q.vec_id AS q, v.vec_id, v.label, round(list_distance(v.e, q.e), 9) AS d FROM v, v q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND v.label IS NOT NULL),
      n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS k FROM p) WHERE k <= 5) SELECT q AS vec_id, round(sum(label / (d + 1e-6)) / sum(1 / (d + 1e-6)), 5) AS estimate, round(avg(d), 5) AS distance FROM n GROUP BY 1""",
    "hybrid_retrieval": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
      c AS (SELECT q.vec_id AS q_id, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS s FROM v, v q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
      a AS (SELECT q_id, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS k FROM c) WHERE k <= 10),
      b AS (SELECT q.vec_id AS q_id, v.vec_id, round(CAST(1 AS DOUBLE) / (1 + abs(v.vec_id - q.vec_id)), 6) AS score FROM v JOIN v q ON q.label = v.label AND v.r BETWEEN q.r + 1 AND q.r + 10 WHERE q.vec_id % 50 = 0),
      g AS (SELECT q_id, vec_id, max(score) AS score, count(*) AS lists FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) SELECT q_id, vec_id, score, lists, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS place FROM g) WHERE place <= 8""",
    "group_zscores": "SELECT p_partkey, p_brand, round(p_retailprice, 5) AS p_retailprice, round(coalesce((p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_pop(p_retailprice) OVER w, 0), 0), 5) AS z FROM part WINDOW w AS (PARTITION BY p_brand)",
    "events_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, time_bucket(INTERVAL 2 HOURS, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') - INTERVAL 2 HOURS * k AS s FROM events, range(3) t(k)) GROUP BY 1",
    "events_sessions": """WITH e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events WHERE user_id IS NOT NULL), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS f FROM e),
      s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(t) AS start, max(t) + 7200000000 AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
}
