"""Operator 13: ranked lexical search by pipelined term partitioning.

Terms are owned by STAGES: a term's document frequency decides its owner, rare terms first. Items travel in bundles. For every block of
documents a bundle has one row for each of its items, which carries the item's terms and a sparse list of accumulators (document, score so far).
At each owner the bundles meet the postings of the owner's terms by cogroup on (bundle, block); the postings' integer
contributions are added to the accumulators, and the bundle goes on to the next owner. After the last one, the best of each block are
ranked for each item.

Between two owners, the score that the item's k-th best document has so far is a lower bound of what its last place needs. An accumulator that
cannot reach it, even with the largest contribution of every term still to come, is dropped, and no new one is opened
when those contributions together stay below it. That never changes a result: only scores strictly below the bound go.

A block holds about BLOCK postings of documents that a hash puts there, so a frequent term's postings are spread over all blocks; a group in
a task is one block's postings of one owner, with a bundle of at most BUNDLE items. Nothing is collected but N, L and counts. The vocabulary and
the owners' table are broadcast only if their measured size is within VOCABULARY_BYTES, and shuffled otherwise.

Null texts and texts without a term are no documents in N and L, and as items give no rows. Items with a null or repeated item_id are ranked row by row.
Repeated doc_ids are documents of their own; equal scores come by ascending doc_id, nulls last. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mortise.llm.graph import BROADCAST_ROWS
from mortise.llm.words import chunks
from mortise.session import discard, materialise

BUNDLE, BLOCK = 256, 200_000
#: A term's owner is the first whose bound its document frequency, as a share of N, does not exceed; the last owner has the rest.
OWNERS = (0.001, 0.02, 0.2)
VOCABULARY_BYTES = 32_000_000
RANKS = 50
#: What is no part of a term becomes a blank, A-Z become a-z.
_TERMS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LISTS = ("terms", "keys", "ids", "scores", "tops")
_ARROW = pa.schema([("bundle", pa.int32()), ("block", pa.int32()), ("item", pa.int64()), *((n, pa.list_(pa.int64())) for n in _LISTS)])
_STATE = "bundle int, block int, item long, " + ", ".join(f"{n} array<long>" for n in _LISTS)
#: Stands for a null doc_id inside the accumulators, and comes last as that does.
_NO_ID = 2**63 - 1


def doc_terms(docs: DataFrame) -> DataFrame:
    """docs (id long, text, key long) -> id, key, n (terms with repeats), term and tf for every distinct term of every text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                sizes, ns, terms, tfs = [], [], [], []
                for t in texts:
                    words = t.translate(_TERMS).split()
                    found = Counter(words)
                    sizes.append(len(found))
                    ns.append(len(words))
                    terms += found
                    tfs += found.values()
                row = pa.array(np.repeat(np.arange(len(ids)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(row), b.column(2).slice(at, len(ids)).take(row), pa.array(ns, pa.int64()).take(row), pa.array(terms, pa.binary()), pa.array(tfs, pa.int64())], names=["id", "key", "n", "term", "tf"])
                at += len(ids)

    return docs.select("id", "text", "key").mapInArrow(of, "id long, key long, n long, term binary, tf long")


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the texts with a term, and L, all their terms with repeats."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                n = len(t.translate(_TERMS).split())
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

    got = docs.select("text").mapInArrow(of, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def measured(df: DataFrame, size: Column) -> DataFrame:
    """A stored table, with a broadcast hint if its rows of the given sizes are within VOCABULARY_BYTES."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= VOCABULARY_BYTES else df


def _numbers(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list starts and the last ends."""
    lengths = np.array([len(v) for v in lists], dtype=np.int64)
    return lists.combine_chunks().flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))


def owner_stage(ranks: int):  # noqa: ANN201
    """What an owner does with a bundle in a block: left are the bundle's rows, right the owner's postings (term, key, id, gain)."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ARROW.empty_table()
        term, gain = right.column("term").to_numpy(), right.column("gain").to_numpy()
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        ends = np.append(starts[1:], len(term))
        wanted, wanted_at = _numbers(left.column("terms"))
        held, held_at = _numbers(left.column("keys"))
        held_scores = _numbers(left.column("scores"))[0]
        posted = right.column("key").to_numpy()
        keys, first = np.unique(np.concatenate((posted, held)), return_index=True)
        ids = np.concatenate((right.column("id").fill_null(_NO_ID).to_numpy(), _numbers(left.column("ids"))[0]))[first]
        spot, gain, held_spot = np.searchsorted(keys, posted)[order], gain[order], np.searchsorted(keys, held)
        place = np.searchsorted(terms, wanted)
        here = place < len(terms)
        here[here] = terms[place[here]] == wanted[here]
        floors, due, rest = (left.column(n).to_numpy() for n in ("floor", "due", "rest"))
        out: dict[str, list] = {n: [] for n in _LISTS[1:]}
        for k in range(left.num_rows):
            own = slice(held_at[k], held_at[k + 1])
            score = np.zeros(len(keys), dtype=np.int64)
            score[held_spot[own]] = held_scores[own]
            mine = slice(wanted_at[k], wanted_at[k + 1])
            for t in place[mine][here[mine]]:
                score[spot[starts[t] : ends[t]]] += gain[starts[t] : ends[t]]
            if due[k] < floors[k]:  # no document without an accumulator can get there any more
                open_ones = np.zeros(len(keys), dtype=bool)
                open_ones[held_spot[own]] = True
                score[~open_ones] = 0
            live = np.flatnonzero((score > 0) & (score + rest[k] >= floors[k]))
            best = np.lexsort((ids[live], -score[live]))[:ranks] if not rest[k] else np.argpartition(-score[live], ranks - 1)[:ranks] if len(live) > ranks else np.arange(len(live))
            out["tops"].append(score[live[best]])
            live = live if rest[k] else live[best]  # an item without terms to come needs its best only
            out["keys"].append(keys[live])
            out["ids"].append(ids[live])
            out["scores"].append(score[live])
        columns = [left.column(n) for n in ("bundle", "block", "item", "terms")] + [pa.array(v, pa.list_(pa.int64())) for v in out.values()]
        return pa.table(columns, names=["bundle", "block", "item", "terms", *out]).cast(_ARROW)

    return add


def search(docs: DataFrame, items: DataFrame, ranks: int = RANKS, bundle: int = BUNDLE, block: int = BLOCK, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item its best documents with a score above 0."""
    row = F.monotonically_increasing_id().alias("key")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), row).where("text is not null")
    names = materialise(items.select(F.col(item_id).alias("item_id"), F.lit(0).cast("long").alias("id"), F.col(text).alias("text"), row).where("text is not null"), "items")
    asked = materialise(doc_terms(names).select(F.col("key").alias("item"), "term"), "asked")
    many, length = totals(docs)
    asking = names.count()
    bundles = max(1, -(-asking // bundle))
    vocabulary = materialise(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_no")), "vocabulary")
    asked_no = asked.join(vocabulary, "term").select("item", "term_no", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"))

    found = doc_terms(docs).join(measured(vocabulary, F.length("term") + 24), "term").withColumn("m", F.expr(f"50 + (50 * n * {many}L) div {max(1, length)}L"))
    postings = materialise(found.select("key", "id", "term_no", F.expr("(1000000000L * tf) div (1000 * tf + 20 * m)").alias("ratio")), "postings")
    stats = postings.groupBy("term_no").agg(F.count(F.lit(1)).alias("df"), F.max("ratio").alias("ratio"))
    weight = F.floor(1000 * F.log((2.0 * many + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owner = F.coalesce(*[F.when(F.col("df") <= share * many, k) for k, share in enumerate(OWNERS)], F.lit(len(OWNERS)))
    routes = asked_no.groupBy("term_no").agg(F.collect_set("bundle").alias("bundles"))
    owners = materialise(stats.join(routes, "term_no").select("term_no", "df", owner.alias("owner"), weight.alias("weight"), (weight * F.col("ratio")).alias("most"), "bundles"), "owners")
    blocks = max(1, -(-(owners.agg(F.sum("df")).first()[0] or 0) // block))
    routed = measured(owners, F.size("bundles") * 4 + 40)

    dues = [F.sum(F.when(F.col("owner") >= s, F.col("most")).otherwise(0)).alias(f"due{s}") for s in range(len(OWNERS) + 2)]
    plan = materialise(asked_no.join(owners.select("term_no", "owner", "most"), "term_no").groupBy("item", "bundle").agg(F.collect_list("term_no").alias("terms"), *dues), "plan")
    nothing = F.array().cast("array<long>")
    state = plan.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item", "terms", *[nothing.alias(n) for n in _LISTS[1:]])
    floors = plan.select("item", F.lit(0).cast("long").alias("floor"))
    for s in range(len(OWNERS) + 1):
        bounds = plan.select("item", F.col(f"due{s}").alias("due"), F.col(f"due{s + 1}").alias("rest")).join(floors, "item", "left")
        bounds = bounds.withColumn("floor", F.coalesce("floor", F.lit(0)))
        left = state.hint("merge").join(bounds, "item") if asking > BROADCAST_ROWS else state.join(F.broadcast(bounds), "item")  # a few numbers for each item
        gains = postings.join(routed.where(F.col("owner") == s), "term_no").select(F.explode("bundles").alias("bundle"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.col("term_no").alias("term"), "key", "id", (F.col("weight") * F.col("ratio")).alias("gain"))
        after = materialise(left.groupBy("bundle", "block").cogroup(gains.groupBy("bundle", "block")).applyInArrow(owner_stage(ranks), _STATE), f"bundles{s}")
        discard(state)
        state = after
        tops = state.select("item", F.explode("tops").alias("floor"))
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("floor")))  # limited before the shuffle
        floors = tops.withColumn("place", place).where(F.col("place") == ranks).select("item", "floor")
    rows = state.select("item", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("item", "x.ids", "x.scores")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("scores"), "ids"))).where(F.col("rank") <= ranks)
    real = F.when(F.col("ids") != _NO_ID, F.col("ids"))
    out = materialise(ranked.join(names.select(F.col("key").alias("item"), "item_id"), "item").select("item_id", "rank", real.alias("doc_id"), F.col("scores").alias("score")), "ranked")
    discard(names, asked, vocabulary, postings, owners, plan, state)
    return out
