"""Keyword, match and repair queries over texts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.functions.matches import all_matches
from mortise.functions.repair import repair_json
from mortise.operators import keywords as kw
from mortise.session import table

# Stop words of the four languages of the table.
STOP = tuple("the of and to in a is that it for on with as was at by be this from or an are not le la les de des du et un une en que qui est pour dans der die das und ist nicht ein eine zu den von mit auf sich im el los las y por con del para lo al se".split())
ROUNDS = 10


def position_rank(spark: SparkSession, sf: str) -> DataFrame:
    return kw.rank_phrases(table(spark, sf, "documents"), "doc_id", "text", STOP, rounds=ROUNDS).select("doc_id", "phrase", "score", "place")


def single_rank(spark: SparkSession, sf: str) -> DataFrame:
    return kw.rank_phrases(table(spark, sf, "documents"), "doc_id", "text", STOP, by_position=False, rounds=ROUNDS).select("doc_id", "phrase", "score", "place")


def topic_rank(spark: SparkSession, sf: str) -> DataFrame:
    return kw.rank_topics(table(spark, sf, "documents"), "doc_id", "text", STOP, rounds=ROUNDS).select("doc_id", "phrase", "score", "place")


NUMBERS = r"[0-9]+(?:[.,][0-9]+)*"


def number_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every number in every document, with its place and the text around it."""
    found = all_matches(table(spark, sf, "documents").select("doc_id", "text"), "text", NUMBERS, before=450, after=650)
    return found.select("doc_id", "ordinal", "start", "end", "match", "window_start", F.sha2("window", 256).alias("window_sha256"))


def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """All turns as JSON answers, damaged in one of five ways by their ids, repaired and read again."""
    whole = F.to_json(F.struct("conv_id", F.struct("turn", F.array("role", F.lit('}"{')).alias("tags")).alias("at"), "role", "text"), {"ignoreNullFields": "false"})
    cut = F.substring(whole, F.lit(1), F.char_length(whole) - 1)
    damaged = F.element_at(
        F.array(
            F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\nDone {really}.")),
            F.concat(cut, F.lit(" , }")),
            F.concat(F.lit("Answer: "), whole, F.lit(" and } more {")),
            F.regexp_replace(cut, r'"$', ""),
            F.concat(cut, F.lit(',"left')),
        ),
        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"),
    )
    got = table(spark, sf, "conversations").select("conv_id", "turn", repair_json(damaged).alias("j"))
    read = F.from_json("j.json", "conv_id long, at struct<turn: int, tags: array<string>>, role string, text string")
    return got.select("j.state", read.alias("r")).select("state", "r.conv_id", "r.at.turn", F.get("r.at.tags", F.lit(0)).alias("tag"), "r.role", "r.text")


QUERIES = {f.__name__: f for f in (position_rank, single_rank, topic_rank, number_matches, json_repair)}

_PLACES = rf"""
w0 AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN length(x) >= 3 AND NOT list_contains([{", ".join(f"'{s}'" for s in STOP)}], x) THEN x END) AS w FROM w0),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM w),
ru AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM each),
pc AS (SELECT doc_id, run, (row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1) // 3 AS piece, x, pos FROM ru WHERE x IS NOT NULL),
occ AS MATERIALIZED (SELECT doc_id, list(x ORDER BY pos) AS words, array_to_string(list(x ORDER BY pos), ' ') AS phrase, min(pos) AS pos FROM pc GROUP BY doc_id, run, piece)"""


def _walk() -> str:
    """From edges e (doc_id, a, b, weight) and nodes n (doc_id, node, bias): rounds r0, r1, ..."""
    steps = ["s AS MATERIALIZED (SELECT e.doc_id, a, b, 0.85 * weight / sum(weight) OVER (PARTITION BY e.doc_id, a) AS share FROM e)", "r0 AS (SELECT doc_id, node, bias AS rank FROM n)"]
    for k in range(ROUNDS):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT doc_id, node, sum(rank) AS rank FROM (SELECT s.doc_id, s.b AS node, s.share * r.rank AS rank FROM s JOIN r{k} r ON r.doc_id = s.doc_id AND r.node = s.a UNION ALL SELECT doc_id, node, (1 - 0.85) * bias FROM n) GROUP BY 1, 2)")
    return ", ".join(steps)


def _phrases(pull: str) -> str:
    return rf"""
WITH {_PLACES},
p AS (SELECT a.doc_id, least(a.x, b.x) AS a, greatest(a.x, b.x) AS b, CAST(count(*) AS DOUBLE) AS weight FROM each a JOIN each b ON a.doc_id = b.doc_id AND b.pos - a.pos IN (1, 2) WHERE a.x <> b.x GROUP BY 1, 2, 3),
e AS MATERIALIZED (SELECT * FROM p UNION ALL SELECT doc_id, b, a, weight FROM p),
f AS (SELECT doc_id, x AS node, {pull} AS pull FROM each WHERE x IS NOT NULL GROUP BY 1, 2),
n AS MATERIALIZED (SELECT doc_id, node, pull / sum(pull) OVER (PARTITION BY doc_id) AS bias FROM f),
{_walk()},
ph AS (SELECT DISTINCT doc_id, phrase, words FROM occ),
sc AS (SELECT u.doc_id, u.phrase, round(sum(r.rank) + 1e-13, 9) AS score FROM (SELECT doc_id, phrase, unnest(words) AS node FROM ph) u JOIN r{ROUNDS} r ON r.doc_id = u.doc_id AND r.node = u.node GROUP BY 1, 2)
SELECT doc_id, phrase, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS place FROM sc QUALIFY place <= 10
"""


ORACLES = {
    "number_matches": r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*') AS m, regexp_split_to_array(text, '[0-9]+(?:[.,][0-9]+)*') AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, text, unnest(m) AS x, unnest(p[1 : len(m)]) AS gap, generate_subscripts(m, 1) AS k FROM t WHERE len(m) > 0),
s AS (SELECT *, CAST(sum(length(gap)) OVER w + coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, CAST(k - 1 AS BIGINT) AS ordinal, start, CAST(start + length(x) AS BIGINT) AS "end", x AS match, greatest(0, start - 450) AS window_start,
  sha256(substr(text, greatest(0, start - 450) + 1, start + length(x) + 650 - greatest(0, start - 450))) AS window_sha256 FROM s
""",
    "json_repair": "SELECT CASE WHEN (conv_id + turn) % 5 < 3 THEN 'whole' ELSE 'completed' END AS state, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS INTEGER) AS turn, role AS tag, role, text FROM conversations",
    "position_rank": _phrases("sum(1.0 / CAST(pos + 1 AS DOUBLE))"),
    "single_rank": _phrases("1.0::DOUBLE"),
    "topic_rank": rf"""
WITH {_PLACES},
o AS (SELECT doc_id, phrase, pos, substr(words[-1], 1, 5) AS topic FROM occ),
p AS (SELECT a.doc_id, least(a.topic, b.topic) AS a, greatest(a.topic, b.topic) AS b, sum(1.0 / CAST(b.pos - a.pos AS DOUBLE)) AS weight FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE a.topic <> b.topic GROUP BY 1, 2, 3),
e AS MATERIALIZED (SELECT * FROM p UNION ALL SELECT doc_id, b, a, weight FROM p),
f AS (SELECT doc_id, topic AS node, arg_min(phrase, pos) AS phrase FROM o GROUP BY 1, 2),
n AS MATERIALIZED (SELECT doc_id, node, phrase, 1.0 / count(*) OVER (PARTITION BY doc_id) AS bias FROM f),
{_walk()},
sc AS (SELECT n.doc_id, n.phrase, round(max(r.rank) + 1e-13, 9) AS score FROM n JOIN r{ROUNDS} r ON r.doc_id = n.doc_id AND r.node = n.node GROUP BY 1, 2)
SELECT doc_id, phrase, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS place FROM sc QUALIFY place <= 10
""",
}
