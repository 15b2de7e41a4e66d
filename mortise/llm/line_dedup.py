"""Operator 1: near-duplicate lines, by MinHash over character shingles, with DataFrame functions only.

Lines are the \\n-separated pieces of a text, compared in lower case, with tabs and carriage returns as blanks, blanks at
the ends aside. A line takes part when it has a letter or a digit, or MARK_CHARS characters or more; blank lines and short marks
("---", "}") hold no text and always stay. A line is the set of all its 8-character shingles, one at every character; a line
of fewer characters is one shingle, so that only its exact copies equal it. Two lines are near-duplicates when the Jaccard
similarity of their sets is 0.8 or more. Of each component of near-duplicate lines one stays: the first line in the
document with the smallest id.

1. A line's characters are encoded at four bytes each, so that a shingle is a slice at a known offset. A row handles STEP
   shingles; their hashes are XORed with fixed seeds, and the minimum for each seed is a MinHash value. One aggregation keyed by a
   128-bit hash of the line takes these minima and the first place where the line occurs, so it also collapses exact copies.
2. BANDS bands of ROWS values: lines of similarity s share a band with probability
   1 - (1 - s^ROWS)^BANDS, 0.995 at 0.8.
3. Every line of a band's bucket is paired with the bucket's first and last line. Pairs whose signatures agree
   in fewer than AGREE of their values are left out (a pair of similarity 0.8 has that few with
   probability 0.0002); the others are verified exactly on the two whole sets of shingles, made from the two texts.
   Links go through graph.components().
4. In buckets that still hold lines of several components, all lines are compared where the bucket has FULL lines at most. The lines of
   larger ones are dealt again, by their rarest shingles. All shingles of these lines are put in one order, rare ones (by a count over
   SLOTS hash slots) first and then by hash. Of two lines whose similarity is 0.8 or more, each of n shingles, the first
   floor(n / 5) + 1 have a shingle in common, whatever the order; so a line goes to a bucket for each of those, and all lines of different
   components that meet there, have sets of fitting sizes and may link by their signatures are verified. That loses no link between lines that shared a band. What a family
   of similar lines has in common is frequent and comes last, so its lines part; a bucket that is large all the same is
   compared in blocks of BLOCK lines, each with the bucket's lines outside its largest component, so that it is many tasks' work.

Defined results. A null or empty text has no lines. A text of any length is one row's arrays; nothing of it is cut. Rows with a
null doc_id come after all others and follow one another by a hash of their text. Rows that share a doc_id but not their text
are documents of their own, ordered by a hash of the text; rows equal in doc_id and text are one document given twice, and keep or lose
the same lines. Ties: of equal lines in one document the first stays. An empty table gives an empty result. Extra
columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.llm.graph import bounded_broadcast, components, joined_in_passes
from mortise.session import discard, materialise

MARK_CHARS = 25
SHINGLE = 8
STEP = 4
BANDS, ROWS = 8, 3
AGREE = 12
#: The columns of a signature, of eight bytes each.
SIG = [f"s{k}" for k in range(BANDS * ROWS // 8)]
THRESHOLD = 80
#: Lines of a band's bucket that are all compared with one another there; lines that a block of a larger bucket holds; slots in which shingles are counted.
FULL, BLOCK, SLOTS = 8, 1000, 2**20
#: A line's place is its document's key * 2^PLACE_BITS + its number in the text.
PLACE_BITS, HASH_BITS = 26, 36
_WIDE = "decimal(38,0)"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _plain(text: Column) -> Column:
    """A text as its lines are compared, but for the blanks at their ends."""
    for mark in ("\t", "\r"):  # looking for a mark costs less than replacing none
        text = F.when(F.contains(text, F.lit(mark)), F.replace(text, F.lit(mark), F.lit(" "))).otherwise(text)
    return F.lower(text)


def _takes_part(line: Column) -> Column:
    """Whether a line of a text without tabs and carriage returns takes part."""
    return F.when(F.char_length(F.trim(line)) >= MARK_CHARS, True).otherwise(line.rlike(r"[\p{L}\p{N}]"))


def _stored(parts: list[DataFrame], name: str) -> DataFrame:
    return materialise(parts[0], name, *parts[1:])


def _key_type(docs: DataFrame) -> str:
    """long where ids are unique and leave room for line numbers, else a decimal that also holds a hash of the text."""
    low, high, rows, ids = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1)), F.count("doc_id")).first()
    if rows == ids and (low is None or (low >= 0 and high < 2 ** (63 - PLACE_BITS))) and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return "long"
    row = docs.select(_key(_WIDE).alias("key"), F.xxhash64(F.lit(2), "text").alias("h"))
    if not row.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        raise ValueError(f"two texts of one doc_id agree in {HASH_BITS} bits of their hash; give the rows ids of their own")
    return _WIDE


def _key(kind: str) -> Column:
    """The key of a row, times 2^PLACE_BITS: the place of its first line."""
    power = lambda n: F.lit(str(2**n)).cast("decimal(31,0)")
    if kind == "long":
        return F.col("doc_id").cast("long") * F.lit(2**PLACE_BITS)
    hashed = lambda bits, seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text"), 64 - bits).cast("decimal(20,0)")
    own = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**HASH_BITS).cast("decimal(11,0)") + hashed(HASH_BITS, 0)
    nameless = power(63 + HASH_BITS) + hashed(63, 1) * F.lit(2**30).cast("decimal(10,0)") + hashed(30, 0)
    return (F.coalesce(own.cast("decimal(31,0)"), nameless.cast("decimal(31,0)")) * F.lit(2**PLACE_BITS).cast("decimal(8,0)")).cast(_WIDE)


def _occurrences(docs: DataFrame, kind: str) -> DataFrame:
    """place, line: each line that takes part."""
    each = docs.select(_key(kind).alias("key"), F.posexplode(_lines(_plain(F.col("text")))).alias("pos", "line"))
    each = each.where(_takes_part(F.col("line")))
    return each.select((F.col("key") + F.col("pos")).cast(kind).alias("place"), F.trim("line").alias("line"))


def _signatures(lines: DataFrame) -> DataFrame:
    """place, SIG (a byte of each MinHash value), band_0..: a row for each distinct line, place being its first."""
    rows = lines.select("place", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), F.encode("line", "UTF-32").alias("u"))
    rows = rows.withColumn("last", F.greatest(F.octet_length("u") - (4 * SHINGLE - 1), F.lit(1)).cast("int"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * STEP))))
    # the last row of a line repeats its last shingle where no other is left
    hashes = [F.xxhash64(F.substring("u", F.least(F.col("i") + 4 * j, F.col("last")), F.lit(4 * SHINGLE))).alias(f"h{j}") for j in range(STEP)]
    rows = rows.select("place", "k1", "k2", "last", *hashes)
    low = lambda seed: F.least(*(F.col(f"h{j}").bitwiseXOR(seed) for j in range(STEP)))
    lows = [F.min(low(F.xxhash64(F.lit(f"seed {i}")))).alias(f"m{i}") for i in range(BANDS * ROWS)]
    each = rows.groupBy("k1", "k2", "last").agg(F.min("place").alias("place"), *lows)
    byte = [F.call_function("shiftleft", F.col(f"m{i}").bitwiseAND(F.lit(255)), F.lit(8 * (i % 8))) for i in range(BANDS * ROWS)]
    packs = [sum(byte[8 * k + 1 : 8 * k + 8], byte[8 * k]).alias(s) for k, s in enumerate(SIG)]
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))).alias(f"band_{b}") for b in range(BANDS)]
    return each.select("place", *packs, *bands)


def _other() -> list[Column]:
    return [F.col(s).alias(f"other_{s}") for s in SIG]


def _may_link() -> Column:
    """Whether a row's signature and the other one agree in AGREE values or more."""
    unlike = F.lit(0)
    for s in SIG:
        x = F.col(s).bitwiseXOR(F.col(f"other_{s}"))
        for mask in (0x7F7F7F7F7F7F7F7F, 0x3F3F3F3F3F3F3F3F):  # a byte that isn't 0 stays so in its lower six bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(mask))
        unlike = unlike + F.bit_count((x + F.lit(0x3F3F3F3F3F3F3F3F)).bitwiseAND(F.lit(0x4040404040404040)))
    return BANDS * ROWS - unlike >= AGREE


def _hashes(line: str) -> Column:
    """The hashes of a line's shingles, with repeats. The outer transform() binds the encoded line, so that it is made once."""
    at = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - (4 * SHINGLE - 1), F.lit(1)).cast("int"), F.lit(4))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), lambda u: F.transform(at(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * SHINGLE))))), F.lit(0))


def _sized(lines: DataFrame) -> DataFrame:
    """place, line, n: lines with the number of their distinct shingles."""
    return lines.select("place", "line", F.size(F.array_distinct(_hashes("line"))).alias("n"))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The near-duplicates (a, b) among stored pairs (a, b) of places, exact on every shingle of both lines (place, line, n)."""
    both = pairs.join(texts.select(F.col("place").alias("a"), F.col("line").alias("la"), F.col("n").alias("na")), "a")
    both = both.join(texts.select(F.col("place").alias("b"), F.col("line").alias("lb"), F.col("n").alias("nb")), "b")
    # the smaller set must be THRESHOLD percent of the larger one, whatever they share
    close = both.where(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect(_hashes("la"), _hashes("lb")))
    return materialise(close.where((100 + THRESHOLD) * shared >= THRESHOLD * (F.col("na") + F.col("nb"))).select("a", "b"), "links")


def _pairs(members: DataFrame) -> DataFrame:
    """members (bucket, place, SIG) -> pairs (a, b) that may be similar: each line with its bucket's first and last."""
    ends = members.groupBy("bucket").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    far = ends.select("bucket", F.explode(F.array("first", "last")).alias("to"))
    to = far.join(members.select("bucket", F.col("place").alias("to"), *_other()), ["bucket", "to"])
    near = members.join(to, "bucket").where((F.col("place") != F.col("to")) & _may_link())
    return materialise(near.select(F.least("place", "to").alias("a"), F.greatest("place", "to").alias("b")).distinct(), "pairs")


def _all_pairs(members: DataFrame) -> DataFrame:
    """members (bucket, place, SIG, root) -> pairs (a, b) of a small bucket with different roots that may be similar."""
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    left = members.join(mixed, "bucket").select("bucket", F.col("place").alias("a"), *SIG, F.col("root").alias("near"))
    right = members.select("bucket", F.col("place").alias("b"), *_other(), F.col("root").alias("far"))
    return left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.col("near") != F.col("far")) & _may_link()).select("a", "b")


def _shingle_pairs(members: DataFrame) -> DataFrame:
    """members (bucket, place, SIG, root, n, left) -> pairs (a, b) of a bucket with different roots that may be similar.

    Lines of the component that has most lines of a bucket meet the others only. A pair is looked at where it may meet for the first time: what is left
    of both lines from this shingle on, in the order of shingles, must hold all that they share.
    """
    many = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = many.groupBy("bucket").agg(F.sum("c").alias("size"), F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    some = members.join(mixed.select("bucket", "major", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket")
    few = some.where(F.col("root") != F.col("major")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    few = few.select("bucket", "block", F.col("place").alias("a"), *SIG, F.col("root").alias("near"), F.col("n").alias("na"), F.col("left").alias("lefta"))
    all_ = some.select("bucket", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int").alias("block"), F.col("place").alias("b"), *_other(), F.col("root").alias("far"), F.col("n").alias("nb"), F.col("left").alias("leftb"), (F.col("root") == F.col("major")).alias("common"))
    fits = (100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb")) & ((100 + THRESHOLD) * F.least("lefta", "leftb") >= THRESHOLD * (F.col("na") + F.col("nb")))
    met = few.join(all_, ["bucket", "block"]).where((F.col("common") | (F.col("a") < F.col("b"))) & (F.col("near") != F.col("far")) & fits & _may_link())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_rare_shingles(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """texts (place, line, n), lines (place, SIG, root) -> bucket, place, SIG, root, n, left (its shingles from this one on): each of the lines in a bucket for every one of its first floor(n / 5) + 1 shingles, rare ones first.

    A shingle's bucket is its place in the order: 19 bits of its count and 44 of its hash.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = texts.join(bounded_broadcast(lines.select("place")), "place").select("place", "n", "line")
    # dealt by place, to a fixed number of parts, as texts: shingles are made after that, and a line's are ranked without another shuffle
    own = own.repartition(parts, "place").select("place", "n", F.array_distinct(_hashes("line")).alias("all_"))
    shingles = lambda rows: rows.select("place", "n", F.explode("all_").alias("h")).withColumn("slot", F.pmod("h", F.lit(SLOTS)))
    counts = materialise(shingles(own).groupBy("slot").agg(F.count(F.lit(1)).alias("seen")), "slots")
    counts = counts.select("slot", F.shiftleft(F.least("seen", F.lit(2**19 - 1)), 44).alias("seen"))
    placed = shingles(own).join(F.broadcast(counts), "slot")  # SLOTS rows
    placed = placed.select("place", "n", F.col("seen").bitwiseOR(F.shiftrightunsigned("h", 20)).alias("bucket"))
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("place").orderBy("bucket")) - 1)  # one line's shingles
    first = placed.where(F.col("at") <= F.floor(F.col("n") * (100 - THRESHOLD) / 100)).select("place", "n", (F.col("n") - F.col("at")).alias("left"), "bucket")
    return first.join(lines, "place").select("bucket", "place", *SIG, "root", "n", "left")


def _open_pairs(members: DataFrame, texts: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a bucket and are in different components so far, and may be similar; without the pairs done."""
    named = members.join(roots.select(F.col("node").alias("place"), "root"), "place", "left").withColumn("root", F.coalesce("root", "place"))
    named = materialise(named, "named")
    mixed = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high and size > 3").select("bucket", "size")
    open_ = _stored(joined_in_passes(named, materialise(mixed, "mixed"), "bucket"), "open")
    large = materialise(open_.where(F.col("size") > FULL).select("place", *SIG, "root").distinct(), "large")
    finer = materialise(_by_rare_shingles(texts, large), "finer")
    pairs = _all_pairs(open_.where(F.col("size") <= FULL).select("bucket", "place", *SIG, "root")).union(_shingle_pairs(finer)).distinct()
    out = materialise(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(named, open_, large, finer)
    return out


def kept_places(docs: DataFrame) -> tuple[DataFrame, str]:
    """The places of the lines that stay (column place), and the type of a place."""
    kind = _key_type(docs)
    lines = _occurrences(docs, kind)
    distinct = materialise(_signatures(lines), "lines")
    members = distinct.select("place", *SIG, F.explode(F.array(*(f"band_{b}" for b in range(BANDS)))).alias("bucket"))
    buckets = materialise(members.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    members = _stored(joined_in_passes(members, buckets, "bucket"), "members")
    wanted = materialise(members.select("place").distinct(), "wanted")
    texts = _stored([_sized(x) for x in joined_in_passes(lines, wanted, "place")], "texts")
    done = _pairs(members)
    roots = components(_verified(texts, done))
    # pairs of the first round whose lines still have different roots are known not to link
    pairs = _open_pairs(members, texts, roots, done)
    links = _verified(texts, pairs)
    if not links.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
    # only lines that are not first in their component go
    gone = materialise(roots.where("node <> root").select(F.col("node").alias("place")), "gone")
    discard(buckets, wanted, members, texts, done, pairs)
    return distinct.select("place").join(bounded_broadcast(gone), "place", "left_anti"), kind


def _by_document(docs: DataFrame) -> tuple[DataFrame, str]:
    """m_key, m_kept: for each document that keeps a line, the numbers of the lines it keeps; and the type of a key."""
    kept, kind = kept_places(docs)
    pos = F.pmod("place", F.lit(2**PLACE_BITS).cast("long" if kind == "long" else "decimal(9,0)")).cast("int")
    return kept.select((F.col("place") - pos).cast(kind).alias("m_key"), pos.alias("pos")).groupBy("m_key").agg(F.collect_list("pos").alias("m_kept")), kind


def _numbers(text: Column) -> Column:
    """The numbers of the lines of a text that take part."""
    marked = F.transform(_lines(_plain(text)), lambda x, i: F.when(_takes_part(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _marked(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (these columns of docs), n_lines, part (numbers of the lines that take part), gone (of those that go)."""
    found, kind = _by_document(docs)
    lines = _lines(F.col("text"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), _key(kind).cast(kind).alias("key"), F.size(lines).alias("n_lines"), _numbers(F.col("text")).alias("part"))
    both = own.join(found, F.col("key") == F.col("m_key"), "left")
    return both.select("row", "n_lines", "part", F.array_except("part", F.coalesce("m_kept", F.array().cast("array<int>"))).alias("gone"))


def line_report(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_compared (lines that take part), n_removed, removed (line numbers from 0, comma-joined)."""
    return _marked(docs.select("doc_id", "text"), ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("part").cast("long").alias("n_compared"),
        F.size("gone").cast("long").alias("n_removed"), F.array_join(F.array_sort("gone"), ",").alias("removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text (and n_chars, where there is such a column, counted anew); a document that loses all it had goes."""
    lines = _lines(F.col("row.text"))
    # Each line is made unique by its number, so that array_except, which is hashed, takes out the removed ones in order.
    numbered = F.transform(lines, lambda x, i: F.concat(F.lpad(i.cast("string"), 10, "0"), x))
    left = F.get(F.transform(F.array(numbered), lambda all_: F.array_except(all_, F.transform("gone", lambda i: F.get(all_, i)))), F.lit(0))
    text = F.array_join(F.transform(left, lambda x: F.substring(x, 11, 2147483647)), "\n")
    both = _marked(docs, docs.columns).select("row", F.explode(F.array(F.when(F.size("gone") > 0, text))).alias("new"))
    both = both.where(F.col("new").isNull() | F.col("new").rlike(r"\S"))
    own = {"text": F.coalesce("new", "row.text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.char_length("new").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return both.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
