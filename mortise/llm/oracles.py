"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = (
    "the of and to in a is that it for on with as was at by be this from or an are not le la les de des du et un une en que qui est pour dans "
    "der die das und ist nicht ein eine zu den von mit auf sich im el los las y que en un una es por con del para lo al se"
)

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2
"""

OP4 = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, u.host, u.path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

OP8 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY 1),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        len(l) AS n_lines, len(list_intersect(list_transform(w, lambda x: lower(x)), string_split('{_STOP}', ' '))) AS stops
      FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 40 * n_words AND n_symbols <= 0.08 * greatest(word_chars, 1)
    AND n_dup_lines <= 0.7 * greatest(n_lines, 1) AND stops >= 1 AS kept FROM b
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + 12], ' '))) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def _op11(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Rounds of assignment and means, one common table expression each."""

    def nearest(r: int) -> str:
        return (
            f"a{r} AS MATERIALIZED (SELECT r, x, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, v.x, m.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) AS d FROM v, m{r} m) GROUP BY r, x)"
        )

    steps = []
    for r in range(rounds):
        steps += [
            nearest(r),
            f"s{r} AS (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY 1, 2)",
            f"m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(y.x, m.x) AS x FROM m{r} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c) y ON y.c = m.c)",
        ]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})),
{", ".join(steps)}, {nearest(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN m{rounds} m ON m.c = a.c
"""


OP11 = _op11()

OP12 = r"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, lang, text,
    xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))]),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS fold FROM documents),
t AS (SELECT r, doc_id, lang, fold, string_split(' ' || trim(regexp_replace(
    array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN length(lower(c)) = 1 THEN lower(c) ELSE c END), ''), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS s FROM c),
i AS (SELECT r, s, unnest(range(1, len(s) + 1)) AS i FROM t WHERE len(s) > 2),
x AS (SELECT r, unnest(CASE WHEN i + 1 < len(s) THEN [s[i], s[i] || s[i + 1], s[i] || s[i + 1] || s[i + 2]] WHEN i < len(s) THEN [s[i], s[i] || s[i + 1]] ELSE [s[i]] END) AS g FROM i),
n AS (SELECT r, g, count(*) AS n FROM x WHERE g <> ' ' GROUP BY 1, 2),
own AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS k FROM n QUALIFY k < 300),
lp AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS p FROM n JOIN t USING (r) WHERE fold <> 2 AND lang IS NOT NULL GROUP BY 1, 2 QUALIFY p < 300),
d AS (SELECT r, l.lang, sum(coalesce(abs(p - k), 300)) AS d, count(*) AS m FROM own CROSS JOIN (SELECT DISTINCT lang FROM lp) l LEFT JOIN lp ON lp.lang = l.lang AND lp.g = own.g GROUP BY 1, 2),
b AS (SELECT r, lang, 1 - CAST(d AS DOUBLE) / CAST(300 * m AS DOUBLE) AS score FROM d QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, lang) = 1)
SELECT t.doc_id, coalesce(fold = 2, false) AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM t LEFT JOIN b ON b.r = t.r
"""

OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark WHERE text IS NOT NULL),
z AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
g AS (SELECT doc_id, t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // l))) AS c FROM p JOIN f USING (t), z),
s AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM b JOIN g USING (t) GROUP BY 1, 2 HAVING sum(c) > 0),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 50
"""

ORACLES = {"op2_ngram_join": OP2, "op4_url_filter": OP4, "op8_quality_rules": OP8, "op9_decontaminate": OP9, "op11_centroid_clusters": OP11, "op12_language_id": OP12, "op13_lexical_search": OP13}
