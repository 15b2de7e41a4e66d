"""Parsing, keyword, record and series queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mortise.functions import parsing as pa
from mortise.operators import records as rc, statistics as st
from mortise.plans.statistics import rounded
from mortise.session import table

# Words that part phrases.
PARTING = ("the", "and", "of", "to", "in", "a", "is", "le", "la", "de", "que", "et", "der", "die", "und", "el", "en", "y", "los")
TERMS = ((r"[0-9]+", 0.05, 0.4), ("@", 0.2, 0.4), (r"(?i)licen[cs]e", 0.15, 0.3))
RULES = ((r"(?i)licen[cs]e", "licence"), ("@", "contact"), (r"[0-9]{4,}", "numbers"))


def rake_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return rc.rake(table(spark, sf, "documents"), "doc_id", "text", PARTING)


def merge_best_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.round("value", 0).alias("strength"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("props"))
    return rc.merge_records(e, ["user_id"], ["kind", "props"], "strength", "event_id")


def content_distinct(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("n_chars").cast("double").alias("n"))
    return rc.content_distinct(d, ["text", "lang"], ["n"], [F.col("doc_id")]).select("doc_id", "lang")


def unique_id_repair(spark: SparkSession, sf: str) -> DataFrame:
    return rc.unique_ids(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey", [F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber")]).select("unique_id", "l_partkey")


def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("size", F.char_length("text"))
    return rc.greedy_budget(c, "conv_id", "turn", "size", "turn", 600)


def quota_selection(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rc.quota_selection(o, "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", 5, 1, 2)


def contains_names(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by the kinds of thing (last words of names of the smallest parts) that their names contain."""
    p = table(spark, sf, "part")
    kinds = p.where("p_size = 1").select(F.element_at(F.split("p_name", " "), -1).alias("kind")).distinct()
    return rc.text_contains(p, "p_partkey", "p_name", kinds, "kind").groupBy("found").agg(F.count(F.lit(1)).alias("n"))


def series_acf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rc.acf(_daily(spark, sf), "event_type", "day", "n", 5), 6)


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"))
    return e.agg(F.count(F.lit(1)).cast("double").alias("n"))


def series_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rc.forecast(_daily(spark, sf), "event_type", "day", "n"), 4)


def series_differences(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day")
    d = _daily(spark, sf).withColumn("d1", F.col("n") - F.lag("n").over(w)).withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    return d.where("d1 is not null").select("event_type", F.col("day").cast("long").alias("day"), "d1", F.coalesce("d2", F.lit(0.0)).alias("d2"))


def triage_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", pa.capped_score(F.col("text"), TERMS).alias("score"), pa.first_rule(F.col("text"), RULES, "body").alias("kind"))
    hint = F.when(F.col("score") >= 0.4, "high").when(F.col("score") >= 0.15, "medium").otherwise("low")
    return d.select("doc_id", "score", "kind", hint.alias("priority"), (F.col("score") >= 0.15).cast("int").alias("should_extract"))


def text_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.coalesce(pa.normal_space(F.col("text")), F.lit(""))).alias("plain"), pa.clean_null(F.col("lang")).alias("lang"), F.char_length(pa.clip(F.col("text"), 200)).cast("long").alias("clipped"))


def list_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", pa.parse_list(F.concat_ws("; ", F.regexp_replace("p_name", " ", " and "), "p_type", F.lit("none"), "p_type")).alias("items"))
    return p.select("p_partkey", F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n"))


def first_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", pa.number(F.col("text")).alias("value"), "text")
    return rounded(d.select("doc_id", "value", pa.number_supported(F.col("value"), F.col("text")).alias("supported")).where("value is not null"), 4)


def formula_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas made of each part's key: symbols by remainders, counts by its size."""
    symbol = lambda k, of: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
    made = F.concat(symbol(F.col("p_partkey"), ("Fe", "Ti", "O")), F.when(F.col("p_size") > 1, F.col("p_size").cast("string")).otherwise(""), symbol(F.col("p_partkey"), ("O", "N")), F.lit("2"))
    return table(spark, sf, "part").select("p_partkey", pa.formula(made).alias("f")).select("p_partkey", "f.*")


def key_value_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", pa.key_values(["source", "lang", "quality"]).alias("fields"))
    parsed = F.str_to_map("fields", F.lit(" ; "), F.lit("="))
    return d.select("doc_id", "fields", F.try_element_at(parsed, F.lit("quality")).try_cast("long").alias("quality"))


def final_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A weighted blend of percentile ranks inside each brand, ascending."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    n = F.count(F.lit(1)).over(Window.partitionBy("p_brand"))
    score = F.round(0.6 * st.average_rank(["p_brand"], "p_retailprice") / n + 0.4 * st.average_rank(["p_brand"], "p_size") / n, 6)
    s = p.select("p_partkey", "p_brand", score.alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("score", "p_partkey")))


def grouped_distinct(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rounded(l.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.avg("l_discount").alias("discount")), 5)


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("b"))
    return e.select(F.to_json(F.struct(F.col("n_name").alias("target"), F.lit("supplies").alias("type"), F.col("n").alias("links"))).alias("edge"))


def embedding_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Per vector the squared lengths of its first and second half and of their difference."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    a, b = F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    delta = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return rounded(table(spark, sf, "embeddings").select("vec_id", square(a).alias("first"), square(b).alias("second"), square(delta).alias("delta")), 6)


QUERIES = {f.__name__: f for f in (
    rake_keywords, merge_best_fields, content_distinct, unique_id_repair, greedy_budget, quota_selection, contains_names, series_acf, series_forecast, series_differences, triage_scores, text_cleaning, list_fields, first_numbers,
    formula_tokens, key_value_text, final_ranking, grouped_distinct, graph_edges, embedding_slices)}
_DAILY = "SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2"
_HITS = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))"
#: quota_selection (two interacting caps) and series_forecast (fitted models) have no twin; tests hold them against brute force.
ORACLES = {
    "merge_best_fields": """WITH e AS (SELECT user_id, event_id, round(value, 0) AS s, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, CASE WHEN event_id % 4 > 0 THEN props END AS props FROM events),
      k AS (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS r FROM e WHERE kind IS NOT NULL), p AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS r FROM e WHERE props IS NOT NULL),
      g AS (SELECT user_id, count(*) AS n, max(s) AS strength FROM e GROUP BY 1) SELECT g.user_id, k.kind, p.props, n, strength FROM g LEFT JOIN k ON k.user_id = g.user_id AND k.r = 1 LEFT JOIN p ON p.user_id = g.user_id AND p.r = 1""",
    "content_distinct": r"SELECT min(doc_id) AS doc_id, any_value(lang) AS lang FROM documents GROUP BY lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'))), coalesce(lang, ''), n_chars",
    "unique_id_repair": """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem) SELECT CASE WHEN k > 1 THEN l_orderkey || '_batch_' || lpad(CAST(k - 1 AS VARCHAR), 5, '0') ELSE CAST(l_orderkey AS VARCHAR) END AS unique_id, l_partkey FROM r""",
    "greedy_budget": """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL),
      f AS (SELECT conv_id, turn, k, s <= 600 AS took, CASE WHEN s <= 600 THEN s ELSE 0 END AS used FROM c WHERE k = 1 UNION ALL
        SELECT c.conv_id, c.turn, c.k, f.used + c.s <= 600, CASE WHEN f.used + c.s <= 600 THEN f.used + c.s ELSE f.used END FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
      SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM f WHERE took""",
    "contains_names": """WITH k AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS kind FROM part WHERE p_size = 1), h AS (SELECT p_partkey, kind FROM part LEFT JOIN k ON contains(' ' || p_name || ' ', ' ' || kind || ' ')) SELECT coalesce(kind, 'Others') AS found, count(*) AS n FROM h GROUP BY 1""",
    "series_acf": f"""WITH d AS ({_DAILY}), x AS (SELECT event_type, day, n - avg(n) OVER (PARTITION BY event_type) AS x, var_pop(n) OVER (PARTITION BY event_type) * count(*) OVER (PARTITION BY event_type) AS v FROM d)
      SELECT a.event_type, b.day - a.day AS lag, round(sum(a.x * b.x) / nullif(any_value(a.v), 0), 6) AS acf FROM x a JOIN x b ON a.event_type = b.event_type AND b.day - a.day BETWEEN 1 AND 5 GROUP BY 1, 2""",
    "series_differences": f"WITH d AS ({_DAILY}), a AS (SELECT *, n - lag(n) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)), b AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY event_type ORDER BY day) AS d2 FROM a) SELECT event_type, day, d1, coalesce(d2, 0) AS d2 FROM b WHERE d1 IS NOT NULL",
    "triage_scores": f"""WITH s AS (SELECT doc_id, round(least(1, least(0.4::DOUBLE, 0.05::DOUBLE * {_HITS('[0-9]+')}) + least(0.4::DOUBLE, 0.2::DOUBLE * {_HITS('@')}) + least(0.3::DOUBLE, 0.15::DOUBLE * {_HITS('(?i)licen[cs]e')})), 4) AS score,
        CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '[0-9]{{4,}}') THEN 'numbers' ELSE 'body' END AS kind FROM documents)
      SELECT doc_id, score, kind, CASE WHEN score >= 0.4 THEN 'high' WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS priority, CAST(score >= 0.15 AS INT) AS should_extract FROM s""",
    "text_cleaning": r"""SELECT doc_id, md5(coalesce(trim(regexp_replace(translate(text, '‐‑‒–—−', '------'), '[ \t\n\r\f\x0b]+', ' ', 'g')), '')) AS plain, CASE WHEN lower(trim(lang)) NOT IN ('', 'none', 'nan', 'null', 'unknown', 'n/a', 'na', '-', 'not reported', 'not specified') THEN trim(lang) END AS lang,
      CAST(CASE WHEN length(text) > 200 THEN length(rtrim(substring(text, 1, 200))) + 15 ELSE length(text) END AS BIGINT) AS clipped FROM documents""",
    "list_fields": "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') || [p_type] AS a FROM part), d AS (SELECT p_partkey, list_filter(a, lambda x, i: list_position(a, x) = i) AS items FROM p) SELECT p_partkey, array_to_string(items, ',') AS items, CAST(len(items) AS BIGINT) AS n FROM d",
    "first_numbers": r"""WITH d AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(translate(text, '−', '-'), '([0-9]),([0-9]{3})', '\1\2', 'g'), '([0-9]),([0-9]{3})', '\1\2', 'g'), '[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'), '') AS DOUBLE) AS value,
        regexp_extract_all(text, '[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?') AS n FROM documents)
      SELECT doc_id, round(value, 4) AS value, len(list_filter(n, lambda x: abs(TRY_CAST(x AS DOUBLE) - value) <= greatest(0.015::DOUBLE, 0.005::DOUBLE * abs(value)))) > 0 AS supported FROM d WHERE value IS NOT NULL""",
    "formula_tokens": """WITH f AS (SELECT p_partkey, ['Fe', 'Ti', 'O'][p_partkey % 3 + 1] AS a, ['O', 'N'][p_partkey % 2 + 1] AS b, CASE WHEN p_size > 1 THEN p_size ELSE 1 END AS n FROM part)
      SELECT p_partkey, CAST(n + 2 AS BIGINT) AS atoms, CAST(CASE WHEN a = b THEN 1 ELSE 2 END AS BIGINT) AS species, CASE WHEN n >= 2 THEN a ELSE b END AS major, a = 'O' OR b = 'O' AS oxide FROM f""",
    "key_value_text": "SELECT d.doc_id, concat_ws(' ; ', 'source=' || source, 'lang=' || lang, 'quality=' || CAST(quality AS VARCHAR)) AS fields, CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "final_ranking": """WITH r AS (SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS b, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
      s AS (SELECT p_partkey, p_brand, round(0.6::DOUBLE * a / n + 0.4::DOUBLE * b / n, 6) AS score FROM r) SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score, p_partkey) AS INT) AS place FROM s""",
    "grouped_distinct": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 5) AS discount FROM lineitem GROUP BY 1, 2",
    "graph_edges": """SELECT '{"target":"' || n_name || '","type":"supplies","links":' || count(*) || '}' AS edge FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "embedding_slices": "WITH v AS (SELECT vec_id, CAST(embedding[1 : len(embedding) // 2] AS DOUBLE[]) AS a, CAST(embedding[len(embedding) // 2 + 1 : 2 * (len(embedding) // 2)] AS DOUBLE[]) AS b FROM embeddings) SELECT vec_id, round(list_dot_product(a, a), 6) AS first, round(list_dot_product(b, b), 6) AS second, round(list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b), 6) AS delta FROM v",
}
# A phrase is compared as text; word rates and phrase scores follow the definition in rake().
ORACLES["rake_keywords"] = rf"""
  WITH t AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}} ]+', ' | ', 'g'), ' +'), lambda w: CASE WHEN list_contains({list(PARTING)}, w) THEN '|' ELSE w END) AS ws FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, string_split(unnest(string_split(array_to_string(ws, ' '), '|')), ' ') AS ws FROM t),
  q AS (SELECT doc_id, list_filter(ws, lambda w: w <> '') AS ws FROM p), c AS (SELECT doc_id, ws, count(*) AS c FROM q WHERE len(ws) BETWEEN 1 AND 4 GROUP BY 1, 2),
  e AS (SELECT doc_id, ws, c, unnest(ws) AS w FROM c), r AS (SELECT doc_id, w, sum(c * len(ws)) / CAST(sum(c) AS DOUBLE) AS rate FROM e GROUP BY 1, 2),
  s AS (SELECT e.doc_id, array_to_string(e.ws, ' ') AS phrase, round(sum(rate), 6) AS score FROM e JOIN r ON r.doc_id = e.doc_id AND r.w = e.w GROUP BY e.doc_id, e.ws),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INT) AS place FROM s) SELECT * FROM k WHERE place <= 30"""
