"""Operator 9: passages of a benchmark inside documents, by one Aho-Corasick automaton.

Texts are lower-cased A-Z and cut into words: runs of a-z, 0-9 and non-ASCII characters. A window is WINDOW consecutive words of an item;
an item of fewer words, but not none, is one window. The automaton holds the windows, each between
blanks, and reads each normalised document once. A document's word inside any occurrence is hit; spans of hit words are mapped
back to the original text. A document is contaminated when n_hit > 0 and 20 * n_hit >= n_words.

The benchmark is collected and broadcast in parts of at most PART_BYTES of normalised text, one automaton each, so a worker
holds one bounded automaton; with several parts the rows are stored with a key of their own, read once for each part and
their hits merged by that key. Null texts have no words. Each row is judged by itself, whatever its doc_id. Windows of an
item without an id count as hits and name no item.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.llm.graph import bounded_broadcast
from mortise.llm.words import LOWER, chunks
from mortise.session import materialise

WINDOW = 13
PART_BYTES = 2_000_000
#: Bytes that are no part of a word become blanks, A-Z become a-z.
NORMAL = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789" or c >= 128 else 32 for c in LOWER)
_WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
_built: dict = {}


def _windows(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def _parts(items: DataFrame) -> list[list[tuple[str | None, bytes]]]:
    """The benchmark's (item_id, normalised text) in parts of bounded size, read row by row."""
    parts: list[list] = [[]]
    size = 0
    for item_id, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = (text or "").encode().translate(NORMAL).split()
        if not words:
            continue
        if size and size + len(words) * 8 > PART_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((item_id, b" ".join(words)))
        size += sum(map(len, words)) + len(words)
    return parts


def _automaton(key: str, part: list[tuple[str | None, bytes]]):  # noqa: ANN202
    """The part's automaton, built once in each Python worker; a pattern's value is its length in words and the items that have it."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        own: dict[bytes, list] = {}
        for item_id, text in part:
            for w in dict.fromkeys(_windows(text.split())):
                own.setdefault(w, []).extend([] if item_id is None else [item_id])
        machine = ahocorasick.Automaton()
        for w, ids in own.items():
            machine.add_word(" " + w.decode("latin-1") + " ", (w.count(b" ") + 1, ids))
        machine.make_automaton()
        _built[key] = machine
    return _built[key]


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets (end exclusive) of the runs of hit words in the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[places[a][0]]), int(chars[places[b - 1][1]])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan(docs: DataFrame, shared, spans: bool) -> DataFrame:  # noqa: ANN001
    """doc_id, n_words, hits (numbers of hit words), items, spans."""
    key = uuid.uuid4().hex  # workers outlive a job, so each broadcast has a name of its own

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for ids, texts in chunks(batches):
            machine = machine or _automaton(key, shared.value)
            n_words, hits, items, places = [], [], [], []
            for t in texts:
                words = t.translate(NORMAL).split()
                n_words.append(len(words))
                own: set[str] = set()
                hit: list[int] = []
                where: list[tuple[int, int]] = []
                if words and len(machine):
                    plain = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    found = list(machine.iter(plain))
                    if found:
                        blank = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), dtype=np.uint8) == 32)
                        mask = np.zeros(len(words), dtype=bool)
                        ends = np.searchsorted(blank, [end for end, _ in found])  # the number of the word behind the match
                        for last, (_, (length, names)) in zip(ends, found, strict=True):
                            mask[last - length : last] = True
                            own.update(names)
                        hit = np.flatnonzero(mask).tolist()
                        where = _spans(t, mask) if spans else []
                hits.append(hit)
                items.append(sorted(own))
                places.append([{"start": a, "end": b} for a, b in where])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "hits", "items", "spans"],
            )

    return docs.mapInArrow(of, "doc_id long, n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>")


def contamination(docs: DataFrame, items: DataFrame, spans: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, items (ids whose windows occur, sorted as strings), contaminated, spans (of hit words in the text)."""
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = _parts(items)
    if len(parts) == 1:
        out = _scan(own, spark.sparkContext.broadcast(parts[0]), bool(spans)).withColumn("n_hit", F.size("hits").cast("long"))
    else:
        rows = materialise(own.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "rows")  # stored, so that every part sees the same keys
        found = [_scan(rows.select(F.col("key").alias("doc_id"), "text"), spark.sparkContext.broadcast(part), bool(spans)) for part in parts]
        all_of = found[0]
        for more in found[1:]:
            all_of = all_of.union(more)
        merged = all_of.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        out = rows.select("key", "doc_id").join(merged.withColumnRenamed("doc_id", "key"), "key").withColumn("n_hit", F.size("hits").cast("long"))
    return out.select("doc_id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def items_digest(items: list[str]) -> str:
    """SHA-256 of the sorted ids, comma-joined; what the query computes with sha2()."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated documents. A row is judged by its own text, whatever its doc_id."""
    keyed = docs.withColumn("_m_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    found = contamination(keyed.select(F.col("_m_key").alias("doc_id"), "text"), items, spans=False)
    gone = materialise(found.where("contaminated").select(F.col("doc_id").alias("_m_gone")).distinct(), "contaminated")
    return keyed.join(bounded_broadcast(gone), F.col("_m_key") == F.col("_m_gone"), "left_anti").drop("_m_key")
