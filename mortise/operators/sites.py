"""Records linked to the site descriptions of their own group: by id, by the only candidate, or by score and margin; and filled from them.

Sites have the group columns, place (long, unique in the group: its order), site (id), label, kind, active, text, chunks (array of strings)
and n_fields (how many descriptors are set). Records have the group columns, record (unique), site (id), text, config and chunks.

Nulls: a null text, label or id is as an empty one; a null chunk is no chunk; a record with a null in a group column, and one of a group
without sites, is unlinked. Of sites that share an id or a score the one of the least place is taken. Every record comes back once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.functions.parsing import clean_null, normal_space
from mortise.session import materialise

# Words that say nothing about a site; weights in hundredths and their caps; bounds of a link.
COMMON = ("site", "surface", "adsorption", "adsorbed", "configuration", "model", "the", "and", "for")
SHARED_WORD, SHARED_WORD_CAP, SHARED_CHUNK, SHARED_CHUNK_CAP, FIELD, FIELD_CAP = 5, 25, 12, 30, 2, 15
ACTIVE, LABEL, KIND, ACTIVE_IN_CONFIG = 20, 25, 15, 15
LEAST, MARGIN, SURE, LOW, HIGH, ONLY = 0.26, 0.04, 0.45, 0.55, 0.78, 0.82

#: Classes of records, and of sites, of a group that meet in one task; more are dealt to blocks.
BLOCK = 1_000


def plain(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9, + and -, with single blanks; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(normal_space(text), F.lit(""))), r"[^a-z0-9+\-]+", " "))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: (F.char_length(t) >= 2) & ~t.isin(*COMMON)))


def _chunks() -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce("chunks", F.array().cast("array<string>")), lambda c: c.isNotNull())))


def _classes(rows: DataFrame, group: list[str], features: list[str], name: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with equal features as one class, named by a digest of the group and the features."""
    named = rows.withColumn(name, F.unhex(F.sha2(F.to_json(F.struct(*group, *features)), 256)))
    return named, named.groupBy(name).agg(*(F.first(c).alias(c) for c in [*group, *features]), *more)


def _dealt(classes: DataFrame, large: DataFrame, group: list[str], name: str, own: str, far: str) -> DataFrame:
    """Classes with their block of their side of the group (own), once for each block of the other side (far); a group that is not large is one block."""
    n = lambda side: F.coalesce(f"{side}s", F.lit(1))
    both = classes.join(F.broadcast(large), group, "left")  # a row for BLOCK classes at most
    return both.withColumns({own: F.pmod(F.xxhash64(name), n(own)).cast("int"), far: F.explode(F.sequence(F.lit(0), n(far) - 1))}).drop(f"{own}s", f"{far}s")


def _best(sites: DataFrame, records: DataFrame, group: list[str]) -> DataFrame:
    """(rid, place, score, ahead): the best site of each class of records, and what it is ahead of the group's next one.

    Every pair of classes is scored in the task where their blocks meet, so that texts are shuffled once for each block they meet and pairs not at all: what leaves
    a task are two scores of a record.
    """
    side = lambda rows, r, s: rows.select(*group, F.lit(r).alias("r"), F.lit(s).alias("s"))
    blocks = lambda n: F.greatest(F.ceil(F.sum(n) / BLOCK), F.lit(1)).cast("int")
    large = side(records, 1, 0).unionByName(side(sites, 0, 1)).groupBy(*group).agg(blocks("r").alias("rblocks"), blocks("s").alias("sblocks")).where("rblocks > 1 or sblocks > 1")
    on = [*group, "rblock", "sblock"]
    # lists of words are made after the shuffle, as they take more room than the text
    left = _dealt(records, large, group, "rid", "rblock", "sblock").repartition(*on).select(*on, "rid", F.col("text").alias("text_r"), "config", _words(F.col("text")).alias("words_r"), F.col("chunks").alias("chunks_r"))
    right = _dealt(sites, large, group, "sid", "sblock", "rblock").repartition(*on).select(*on, "label", "kind", "active", F.split("words", " ").alias("words"), "chunks", "n_fields", "place", "n")
    scored = left.join(right, on).select(*on, "rid", "place", "n", pair_score().alias("score"))
    equal = lambda rows, keys: rows.groupBy(*keys, "score").agg(F.min("place").alias("place"), F.sum("n").alias("n"))
    ranked = lambda keys: Window.partitionBy(*keys).orderBy(F.col("score").desc())
    two = equal(scored, [*on, "rid"]).withColumn("k", F.row_number().over(ranked([*on, "rid"]))).where("k <= 2")
    whole = equal(two.select("rid", "score", "place", "n").repartition("rid"), ["rid"])
    following = F.coalesce(F.lead("score").over(ranked(["rid"])), F.lit(0.0))
    whole = whole.withColumns({"k": F.row_number().over(ranked(["rid"])), "ahead": F.when(F.col("n") > 1, 0.0).otherwise(F.col("score") - following)})
    return whole.where("k = 1").select("rid", "place", "score", "ahead")


def pair_score() -> Column:
    """The score of a pair of classes, from 0 to 1.45 in steps of .01."""
    holds = lambda text, part: (F.col(part) != "") & F.contains(F.col(text), F.col(part))
    worth = lambda test, w: F.when(test, w).otherwise(0)
    shared = F.least(F.lit(SHARED_WORD_CAP), SHARED_WORD * F.size(F.array_intersect("words", "words_r")))
    chunks = F.least(F.lit(SHARED_CHUNK_CAP), SHARED_CHUNK * F.size(F.array_intersect("chunks", "chunks_r")))
    fields = F.least(F.lit(FIELD_CAP), FIELD * F.col("n_fields"))
    return (shared + chunks + fields + worth(holds("text_r", "active"), ACTIVE) + worth(holds("text_r", "label"), LABEL) + worth(holds("text_r", "kind"), KIND) + worth(holds("config", "active"), ACTIVE_IN_CONFIG)) / 100.0


def link_sites(sites: DataFrame, records: DataFrame, group: list[str]) -> DataFrame:
    """(group columns, record, method, confidence, place): exact_site_id, unique_system_site, fuzzy_site_match or unlinked, for every record."""
    s = sites.select(*group, "place", clean_null(F.col("site")).alias("site"), plain(clean_null(F.col("label"))).alias("label"), plain(clean_null(F.col("kind"))).alias("kind"),
                     F.lower(F.coalesce(clean_null(F.col("active")), F.lit(""))).alias("active"), F.array_join(_words(plain(F.col("text"))), " ").alias("words"), _chunks().alias("chunks"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))
    r = records.select(*group, "record", clean_null(F.col("site")).alias("site"), plain(F.col("text")).alias("text"), plain(F.col("config")).alias("config"), _chunks().alias("chunks"))
    ids = s.where("site is not null").groupBy(*group, "site").agg(F.min("place").alias("by_id"))
    only = s.where("n_fields > 0").groupBy(*group).agg(F.count(F.lit(1)).alias("informative"), F.min("place").alias("by_only"))
    named, classes = _classes(r, group, ["text", "config", "chunks"], "rid")
    r = materialise(named.select(*group, "record", "site", "rid").join(ids, [*group, "site"], "left").join(only, group, "left"), "records")

    open_ = r.where("by_id is null and informative > 1").select("record", "rid")
    classes = materialise(classes.join(open_.select("rid").distinct(), "rid", "left_semi"), "record-classes")
    many = s.where("n_fields > 0").withColumn("n_fields", F.least("n_fields", F.lit(8)))
    _, kinds = _classes(many, group, ["label", "kind", "active", "words", "chunks", "n_fields"], "sid", F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    best = _best(materialise(kinds, "site-classes"), classes, group)
    best = best.where((F.col("score") >= LEAST) & ((F.col("ahead") >= MARGIN) | (F.col("score") >= SURE)))
    fuzzy = open_.join(best, "rid").select("record", F.col("place").alias("by_score"), "score")

    out = r.join(fuzzy, "record", "left")
    alone = F.col("informative") == 1
    return out.select(
        *group, "record",
        F.when(F.col("by_id").isNotNull(), "exact_site_id").when(alone, "unique_system_site").when(F.col("by_score").isNotNull(), "fuzzy_site_match").otherwise("unlinked").alias("method"),
        F.when(F.col("by_id").isNotNull(), 1.0).when(alone, ONLY).when(F.col("by_score").isNotNull(), F.least(F.greatest("score", F.lit(LOW)), F.lit(HIGH))).otherwise(0.0).alias("confidence"),
        F.coalesce("by_id", F.when(alone, F.col("by_only")), "by_score").alias("place"),
    )


def fill_from_sites(records: DataFrame, links: DataFrame, sites: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """records with method, confidence, place and repaired: a field that is null or blank takes the linked site's value, and its name is listed."""
    given = sites.select(*group, "place", *(F.col(f).alias(f"{f}_site") for f in fields))
    both = records.join(links.select("record", "method", "confidence", "place"), "record", "left").join(given, [*group, "place"], "left")
    lacks = {f: (F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")) & F.col(f"{f}_site").isNotNull() for f in fields}
    names = F.filter(F.array(*(F.when(lacks[f], F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    filled = both.withColumn("repaired", names).withColumns({f: F.when(lacks[f], F.col(f"{f}_site")).otherwise(F.col(f)) for f in fields})
    return filled.select(*records.columns, "method", "confidence", "place", "repaired")


def link_score(system: Column, site: Column, record: Column, metric: Column, electronic: Column, network: Column, bridge: Column, confidence: Column) -> Column:
    """How complete a linked record is: the weights of its parts (booleans, null as false) and .05 of the link's confidence, at most 1, rounded to 4."""
    # The base and the weights of the parts.
    parts = ((system, 0.20), (site, 0.20), (record, 0.20), (metric, 0.15), (electronic, 0.05), (network, 0.03), (bridge, 0.02))
    score = F.lit(0.15)
    for test, weight in parts:
        score = score + F.when(test, weight).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.round(F.least(F.lit(1.0), score), 4) + 0.05 * F.coalesce(confidence, F.lit(0.0))), 4)
