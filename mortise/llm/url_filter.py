"""Operator 4: URL rules, matched through host-suffix and path-prefix expressions.

A rule has a host, a path and a verdict. It fits a URL when the URL's host is the rule's host or a subdomain of
it, and the URL's path starts with the rule's. Of the rules that fit, the longest (host and
path together) wins; among equally long ones the longer host, then block. No rule: DEFAULT.

Each URL is expanded to every suffix of its host at a label boundary, joined with every prefix of its path that has the
length of some rule's path. An expression's SHA-256 is cut to 4 bytes for the equi-join;
the full digest confirms what it finds. The winner is a max() over the URL's hits, combined before the shuffle.

A null or scheme-less URL has an empty host and path and fits no rule. Repeated page ids are judged row by row,
as the host and the path, not the id, are the key: equal (host, path) are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mortise.llm.graph import bounded_broadcast
from mortise.session import materialise

DEFAULT = "allow"
SHORT = 8  # hex digits of the digest that are joined on


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules (host, path, verdict) -> a row for each row of pages: the id, host, path, rule (null where none fits), verdict.

    Rules are broadcast while a count proves them few (graph.BROADCAST_ROWS); beyond that the
    hash prefix is shuffled.
    """
    joined = F.concat("host", "path")
    book = rules.select(F.lower("host").alias("host"), "path", "verdict").dropna().distinct().select(
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("r_digest"), joined.alias("r_rule"),
        F.struct(F.char_length(joined).alias("long"), F.char_length("host").alias("h"), (F.col("verdict") == "block").alias("b"), joined.alias("rule"), F.col("verdict").alias("verdict")).alias("won"),
        F.char_length("path").alias("n"),
    )
    book = materialise(book.withColumn("r_short", F.substring("r_digest", 1, SHORT)), "rules")
    lengths = sorted(r[0] for r in book.select("n").distinct().collect())  # at most the longest rule's length
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths)).cast("array<string>"), lambda x: x.isNotNull())
    each = own.select("host", "path").distinct().where("host <> ''")
    each = each.select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s", F.explode(prefixes).alias("p"))
    each = each.withColumn("digest", F.sha2(F.concat_ws("\n", "s", "p"), 256)).withColumn("short", F.substring("digest", 1, SHORT))
    hits = each.join(bounded_broadcast(book), (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")))
    best = hits.groupBy(F.col("host").alias("h_"), F.col("path").alias("p_")).agg(F.max("won").alias("won"))
    out = own.join(best, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(DEFAULT)).alias("verdict"))
