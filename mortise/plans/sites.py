"""Questions linked to answers of their conversation, and fields held against their text, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.functions import parsing as pa, support as su
from mortise.operators import sites as si
from mortise.session import table


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as sites of their conversation: id, label, kind and active atom are taken from the text."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    low = F.lower("text")
    n = sum((t.cast("int") for t in (F.char_length("text") > 300, F.col("text").rlike("[0-9]"), F.col("text").rlike("\n"), F.col("text").rlike("[,;]"))), F.lit(0))
    return c.select("conv_id", F.col("turn").cast("long").alias("place"), F.concat(F.lit("t"), F.col("turn")).alias("site"), F.regexp_extract(low, "[a-z]{6,}", 0).alias("label"), F.regexp_extract(low, "[a-z]{4,5}", 0).alias("kind"),
                    F.regexp_extract("text", "[A-Z][a-z]", 0).alias("active"), "text", F.array((F.col("turn") / 4).cast("int").cast("string")).alias("chunks"), F.coalesce(n, F.lit(0)).alias("n_fields"),
                    F.char_length("text").cast("long").alias("size"), F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).alias("amount"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as records; one in seven names the turn that follows it."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    names = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 0
    return c.select("conv_id", F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("record"), F.when(names, F.concat(F.lit("t"), F.col("turn") + 1)).alias("site"), "text", F.substring("text", 1, 60).alias("config"), F.array((F.col("turn") / 4).cast("int").cast("string")).alias("chunks"),
                    F.when(F.char_length("text") > 200, F.char_length("text")).cast("long").alias("size"), F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).alias("amount"))


def record_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every question with the answer of its conversation that it is about, by id, by being the only one, or by score."""
    q = _questions(spark, sf)
    links = si.link_sites(_answers(spark, sf), q, ["conv_id"])
    both = links.join(q.select("record", "amount", "size"), "record")
    score = si.link_score(F.lit(True), F.col("place").isNotNull(), F.lit(True), F.col("amount").isNotNull(), F.col("size") > 300, F.col("size") > 350, F.col("size").isNull(), F.col("confidence"))
    return both.select("conv_id", "record", "method", "confidence", "place", score.alias("link_score"), F.col("method").isin("unique_system_site", "fuzzy_site_match").cast("int").alias("soft"))


def record_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose missing size and amount are filled from the linked answer."""
    a, q = _answers(spark, sf), _questions(spark, sf)
    out = si.fill_from_sites(q, si.link_sites(a, q, ["conv_id"]), a, ["conv_id"], ["size", "amount"])
    return out.select("conv_id", "record", "size", "amount", "method", F.array_join("repaired", ",").alias("repaired"))


def field_support(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of every document held against its text: its first number, its stated length, source and language."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("length"), F.lit("characters").alias("length_unit"), pa.number(F.col("text")).alias("amount"))
    d, e = su.with_evidence(d, "text")
    d = d.withColumns({"status": su.field_status(["amount", "length"], ["source", "lang"], e), "score": su.match_score([F.col("source"), F.col("lang"), F.lit("unknown"), F.substring("text", 1, 12), F.lit("model of the surface")], e)} | su.drop_unsupported(["amount", "length"], {"length": "length_unit"}, e))
    states = [F.col("status")[f].alias(f"{f}_status") for f in ("source", "lang")] + [F.col("number_status")[f].alias(f"{f}_status") for f in ("amount", "length")]
    return d.select("doc_id", F.round("amount", 4).alias("amount"), "length", "length_unit", *states, su.status_count(F.col("status"), "supported").cast("long").alias("n_supported"), (su.status_count(F.col("number_status"), "dropped") > 0).alias("any_dropped"), "score")


QUERIES = {f.__name__: f for f in (record_links, record_fills, field_support)}

_SPACE = r"trim(regexp_replace(translate({0}, '‐‑‒–—−', '------'), '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_PLAIN = rf"trim(regexp_replace(lower(coalesce({_SPACE}, '')), '[^a-z0-9+\-]+', ' ', 'g'))"
_COMMON = "['site', 'surface', 'adsorption', 'adsorbed', 'configuration', 'model', 'the', 'and', 'for']"
_WORDS = f"list_distinct(list_filter(string_split({{0}}, ' '), lambda t: length(t) >= 2 AND NOT list_contains({_COMMON}, t)))"
_LINKED = rf"""
t AS (SELECT conv_id, turn, role, text, [CAST(turn // 4 AS VARCHAR)] AS chunks, nullif(regexp_extract(text, '[0-9]+'), '') AS amount FROM conversations),
s0 AS (SELECT *, 't' || turn AS site, lower(text) AS low, coalesce((length(text) > 300)::INT + regexp_matches(text, '[0-9]')::INT + contains(text, chr(10))::INT + regexp_matches(text, '[,;]')::INT, 0) AS n_fields FROM t WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, site, chunks, n_fields, amount, length(text) AS size, regexp_extract(low, '[a-z]{{6,}}') AS label, regexp_extract(low, '[a-z]{{4,5}}') AS kind, lower(regexp_extract(text, '[A-Z][a-z]')) AS active, {_WORDS.format(_PLAIN.format('text'))} AS words FROM s0),
q AS (SELECT conv_id, conv_id || '-' || turn AS record, CASE WHEN (conv_id + turn) % 7 = 0 THEN 't' || (turn + 1) END AS site, {_PLAIN.format('text')} AS text, {_PLAIN.format('substring(text, 1, 60)')} AS config, chunks, amount, CASE WHEN length(text) > 200 THEN length(text) END AS size FROM t WHERE role = 'user'),
p AS (SELECT q.record, q.site AS wanted, s.site, s.turn, s.n_fields, CAST(least(25, 5 * len(list_intersect(s.words, {_WORDS.format('q.text')}))) + least(30, 12 * len(list_intersect(s.chunks, q.chunks))) + least(15, 2 * s.n_fields)
    + CASE WHEN active <> '' AND contains(q.text, active) THEN 20 ELSE 0 END + CASE WHEN label <> '' AND contains(q.text, label) THEN 25 ELSE 0 END + CASE WHEN kind <> '' AND contains(q.text, kind) THEN 15 ELSE 0 END + CASE WHEN active <> '' AND contains(q.config, active) THEN 15 ELSE 0 END AS DOUBLE) / 100 AS score FROM q JOIN s USING (conv_id)),
g AS (SELECT record, min(turn) FILTER (wanted = site) AS by_id, count(*) FILTER (n_fields > 0) AS informative, min(turn) FILTER (n_fields > 0) AS by_only FROM p GROUP BY 1),
b AS (SELECT record, turn AS by_score, score, score - coalesce(lead(score) OVER w, 0) AS ahead FROM p WHERE n_fields > 0 WINDOW w AS (PARTITION BY record ORDER BY score DESC, turn) QUALIFY row_number() OVER w = 1),
f AS (SELECT * FROM b WHERE score >= 0.26::DOUBLE AND (ahead >= 0.04::DOUBLE OR score >= 0.45::DOUBLE)),
l AS (SELECT q.*, CASE WHEN by_id IS NOT NULL THEN 'exact_site_id' WHEN informative = 1 THEN 'unique_system_site' WHEN by_score IS NOT NULL THEN 'fuzzy_site_match' ELSE 'unlinked' END AS method,
    CASE WHEN by_id IS NOT NULL THEN 1.0::DOUBLE WHEN informative = 1 THEN 0.82::DOUBLE WHEN by_score IS NOT NULL THEN least(greatest(score, 0.55::DOUBLE), 0.78::DOUBLE) ELSE 0.0::DOUBLE END AS confidence,
    CAST(CASE WHEN by_id IS NOT NULL THEN by_id WHEN informative = 1 THEN by_only ELSE by_score END AS BIGINT) AS place FROM q LEFT JOIN g USING (record) LEFT JOIN f USING (record))"""
_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_SUPPORTED = "len(list_filter(n, lambda x: abs(TRY_CAST(x AS DOUBLE) - {0}) <= greatest(0.015::DOUBLE, 0.005::DOUBLE * abs({0})))) > 0"
_STATUS = f"CASE WHEN {{0}} IS NULL THEN 'missing' WHEN coalesce({_SUPPORTED}, false) THEN 'supported' ELSE 'dropped_not_in_evidence' END"


def _words3(text: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9+\-]{{2,}}'), lambda x: lower(x)))"


def _text_status(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'missing' WHEN e = '' OR contains(lower(e), lower({c})) OR len(list_intersect({_words3(c)}, w)) > 0 THEN 'supported' ELSE 'weak_or_unsupported' END"


ORACLES = {
    "record_links": f"""WITH {_LINKED}
      SELECT conv_id, record, method, confidence, place, round(least(1.0::DOUBLE, round(0.55::DOUBLE + CASE WHEN place IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN amount IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN size > 300 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN size > 350 THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN size IS NULL THEN 0.02::DOUBLE ELSE 0 END, 4) + 0.05::DOUBLE * confidence), 4) AS link_score,
        CAST(method IN ('unique_system_site', 'fuzzy_site_match') AS INT) AS soft FROM l""",
    "record_fills": f"""WITH {_LINKED}
      SELECT l.conv_id, record, coalesce(l.size, s.size) AS size, coalesce(l.amount, s.amount) AS amount, method, concat_ws(',', CASE WHEN l.size IS NULL AND s.size IS NOT NULL THEN 'size' END, CASE WHEN l.amount IS NULL AND s.amount IS NOT NULL THEN 'amount' END) AS repaired
      FROM l LEFT JOIN s ON s.conv_id = l.conv_id AND s.turn = l.place""",
    "field_support": rf"""WITH d AS (SELECT doc_id, source, lang, CAST(n_chars AS DOUBLE) AS length, coalesce({_SPACE.format('text')}, '') AS e, {_SPACE.format('substring(text, 1, 12)')} AS head, regexp_extract_all(text, '{_NUMBER}') AS n,
        TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(translate(text, '−', '-'), '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '{_NUMBER}'), '') AS DOUBLE) AS amount FROM documents),
      w AS (SELECT *, {_words3('e')} AS w FROM d),
      t AS (SELECT *, list_filter([source, lang, head, 'model of the surface'], lambda t: t IS NOT NULL AND NOT list_contains(['', 'none', 'nan', 'null', 'unknown', 'n/a', 'na', '-', 'not reported', 'not specified'], lower(t))) AS terms, {_STATUS.format('amount')} AS amount_status, {_STATUS.format('length')} AS length_status, {_text_status('source')} AS source_status, {_text_status('lang')} AS lang_status FROM w)
      SELECT doc_id, CASE WHEN amount_status = 'supported' THEN round(amount, 4) END AS amount, CASE WHEN length_status = 'supported' THEN length END AS length, CASE WHEN length_status <> 'dropped_not_in_evidence' THEN 'characters' END AS length_unit, source_status, lang_status, amount_status, length_status,
        CAST(len(list_filter([source_status, lang_status, amount_status, length_status], lambda s: s = 'supported')) AS BIGINT) AS n_supported, amount_status LIKE 'dropped%' OR length_status LIKE 'dropped%' AS any_dropped,
        coalesce(round(list_sum(list_transform(terms, lambda x: CASE WHEN contains(lower(e), lower(x)) THEN 1.0::DOUBLE WHEN len(list_intersect({_words3('x')}, w)) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) / len(terms), 4), 0) AS score FROM t""",
}
