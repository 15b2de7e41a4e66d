"""Operator 2: documents whose sets of word n-grams have a Jaccard similarity of a threshold or more, by signature trees.

Documents with equal sets form a class; classes are what is joined. Two linked sets of sizes a and b share
ceil(t a) and ceil(t b) shingles at least, so they share one of the first a - ceil(t a) + 1 and b - ceil(t b) + 1 in any
order common to all documents. The order here is by how often a shingle's hash slot occurs in the corpus (a table of SLOTS
counts over all documents, of fixed size), so that these prefixes hold rare shingles and frequent passages make no cells.

1. A cell is a prefix shingle, with a range of sizes, that two or more classes share. Cells with the same classes are one cell
   (compared by count, sum and xor of ids, without listing them); cells of two whose sizes forbid a link are left out.
2. In a cell, a signature tree is built: leaves are classes, ordered by size; an inner node holds the OR of its children's token bitmaps and
   their range of sizes. Two copies of the tree are traversed together; a pair of nodes is dropped when the
   sizes or the greatest possible overlap (common bits, plus the tokens that share bits) rule a link out, or
   when all that lies below is known to be connected. Leaf pairs that remain are verified exactly.
3. A cell yields links that connect what it found connected, not all pairs; graph.components() does the rest.
4. A cell of more than BLOCK classes is dealt to blocks. Each block gets the cell's first class too. Classes that
   get connected to it need no comparison with one another; those that remain are compared with every block.
   This is exact; its work grows with the square of a cell's size only when a cell's classes share a rare
   shingle and are yet unlinked.

Nothing is dropped: the result has the components of all links. Null and empty texts have an empty set and no links.
A row with a null doc_id has no links and a null component. Rows that share a doc_id are documents of their own, told apart by
their text; equal rows have equal results. Ties: of equal ids in a component all rows stay in keep_one(). A very long text is one
row's set, in a chunk of its own. An empty table gives an empty result; extra columns of any name pass through keep_one().
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from mortise.llm.graph import bounded_broadcast, components
from mortise.llm.words import chunks, shingle_sets
from mortise.session import discard, materialise

SLOTS = 1 << 21
PIECES = 16
FANIN = 256
BLOCK = 2_000
CALL = 500
FANOUT = 8


def _frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles fall in each of SLOTS hash slots: 16 MB, however large the corpus. Each task's counts are added up in steps of FANIN at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for _, texts in chunks(batches):
            np.add.at(total, (np.concatenate(shingle_sets(texts, n)) >> np.uint64(43)).astype(np.int64), 1)
        part = TaskContext.get().partitionId()
        for k, own in enumerate(np.split(total, PIECES)):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS // PIECES, dtype=np.int64)
        for x in frame["counts"]:
            total += np.frombuffer(zlib.decompress(x), dtype=np.int64)
        return pd.DataFrame({"piece": frame["piece"][:1], "part": frame["part"][:1] // FANIN, "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "piece int, part int, counts binary"
    got = docs.mapInArrow(count, kind)
    for _ in range(3):  # FANIN^3 tasks come down to one
        got = got.groupBy("piece", F.floor(F.col("part") / FANIN)).applyInPandas(add, kind)
    total = np.zeros((PIECES, SLOTS // PIECES), dtype=np.int64)
    for r in got.collect():  # PIECES rows of SLOTS / PIECES counts
        total[r["piece"]] += np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
    return total.ravel()


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _sets(docs: DataFrame, n: int, percent: int, often: np.ndarray) -> DataFrame:
    """docs (row, text) -> row (doc_id and the text's hash), n_shingles, digest (of the set; empty for the empty set), prefix, bits (the set's bitmap)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(often, 2**31 - 1).astype(np.int32))  # SLOTS counts

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for ids, texts in chunks(batches):
            sizes, digests, prefixes, bits = [], [], [], []
            for s in shingle_sets(texts, n):
                m = len(s)
                first = m - (percent * m + 99) // 100 + 1 if m else 0
                order = np.lexsort((s, rank[(s >> np.uint64(43)).astype(np.int64)]))[:first]
                sizes.append(m)
                digests.append(_digest(s))
                prefixes.append(s[order].view(np.int64))
                bits.append(bitmap(s).tobytes())
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            cuts = np.cumsum([0] + [len(p) for p in prefixes]).astype(np.int32)
            row = pa.array(ids, pa.struct([("doc_id", pa.int64()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int64())), pa.array(bits, pa.binary())],
                names=["row", "n_shingles", "digest", "prefix", "bits"],
            )

    return docs.mapInArrow(of, "row struct<doc_id:long,hash:long>, n_shingles long, digest binary, prefix array<long>, bits binary")


def _arrays(docs: DataFrame, n: int) -> DataFrame:
    """docs (row, text) -> digest, tokens (the whole set, as bytes)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "tokens"])

    return docs.mapInArrow(of, "digest binary, tokens binary")


class _Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))])


def bitmap(tokens: np.ndarray, words: int = 0) -> np.ndarray:
    """A bitmap of tokens in words of 64 bits; by default a power of two that holds two bits a token."""
    words = words or 1 << max(0, (len(tokens) - 1) // 32).bit_length()
    out = np.zeros(words, dtype=np.uint64)
    slot = (tokens >> np.uint64(20)) % np.uint64(64 * words)
    np.bitwise_or.at(out, (slot // np.uint64(64)).astype(np.int64), np.uint64(1) << (slot % np.uint64(64)))
    return out


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same tokens in fewer words."""
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def _possible(most: np.ndarray, extra_a: np.ndarray, extra_b: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether common bits, and tokens that share bits, leave room for the overlap that a link needs between sets of the given total size."""
    return most + np.minimum(extra_a, extra_b) >= -(-percent * sizes // (100 + percent))


def candidates(leaf: np.ndarray, size: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal of the signature tree over sets with the given bitmaps and sizes: the pairs that may be linked and are not in one component yet."""
    order = np.argsort(size, kind="stable")
    # levels from the leaves up: bitmap, smallest and largest size, most tokens that share bits, component (-1: several)
    level = [leaf[order], size[order], size[order], (size - np.bitwise_count(leaf).sum(1).astype(np.int64))[order], comp[order]]
    tree = [level]
    while len(level[1]) > 1:
        cut = np.arange(0, len(level[1]), FANOUT)
        low, high = np.minimum.reduceat(level[4], cut), np.maximum.reduceat(level[4], cut)
        level = [np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut), np.where(low == high, low, -1)]
        tree.append(level)
    a = b = np.zeros(1, dtype=np.int64)
    for depth in range(len(tree) - 1, -1, -1):
        bits, low, high, extra, same = tree[depth]
        keep = ~((same[a] == same[b]) & (same[a] >= 0)) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        a, b = a[keep], b[keep]
        fits = np.zeros(len(a), dtype=bool)
        for k in range(0, len(a), 50_000):
            i, j = a[k : k + 50_000], b[k : k + 50_000]
            most = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64)
            fits[k : k + 50_000] = _possible(most, extra[i], extra[j], low[i] + low[j], percent)
        a, b = a[fits], b[fits]
        if not len(a) or not depth:
            break
        below = len(tree[depth - 1][1])
        i = (a[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None] + np.zeros((1, 1, FANOUT), dtype=np.int64)).ravel()
        j = (b[:, None, None] * FANOUT + np.arange(FANOUT)[None, None, :] + np.zeros((1, FANOUT, 1), dtype=np.int64)).ravel()
        keep = (i < below) & (j < below) & (i <= j)
        a, b = i[keep], j[keep]
    return order[a], order[b]


def promising(bitmaps: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets may be linked to another one of them, as far as bitmaps and sizes tell."""
    n, words = len(size), min(map(len, bitmaps))
    leaf = np.stack([_fold(x, words) for x in bitmaps])
    extra = size - np.bitwise_count(leaf).sum(1).astype(np.int64)
    marked = np.zeros(n, dtype=bool)
    for _ in range(3):  # in a group of near copies a star marks nearly all
        rest = np.flatnonzero(~marked)
        if not len(rest):
            return marked
        x = int(rest[len(rest) // 2])
        most = np.bitwise_count(leaf & leaf[x]).sum(1).astype(np.int64)
        near = _possible(most, extra, extra[x], size + size[x], percent) & (100 * size >= percent * size[x]) & (100 * size[x] >= percent * size)
        near[x] = False
        if near.any():
            marked |= near
            marked[x] = True
    a, b = candidates(leaf, size, np.where(marked, 0, np.arange(1, n + 1)), percent)
    apart = a != b
    marked[a[apart]] = marked[b[apart]] = True
    return marked


def connect(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of the sets (sorted, distinct, not empty) the index of the first set of its component."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if 100 * min(map(len, sets)) >= percent * max(map(len, sets)) else 0
        return np.array([0, 0 if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common) else 1])
    forest = _Forest(n)
    size = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)[:-1]))

    def linked(a: int, others: np.ndarray) -> np.ndarray:
        """Of others, those linked to a."""
        if len(others) < n:
            own = np.concatenate([sets[b] for b in others])
            at = np.concatenate(([0], np.cumsum(size[others])[:-1]))
        else:
            own, at = flat, starts
        place = np.searchsorted(sets[a], own)
        common = np.add.reduceat((sets[a][np.minimum(place, size[a] - 1)] == own).astype(np.int64), at)
        return others[100 * common >= percent * (size[a] + size[others] - common)]

    # A few stars first: in a group of near copies they connect nearly all, and the traversal has little left to do.
    left = np.arange(n)
    for _ in range(3):
        for b in linked(int(left[len(left) // 2]), np.arange(n)):
            forest.join(int(left[len(left) // 2]), int(b))
        roots = forest.labels()
        left = np.flatnonzero(roots != np.bincount(roots).argmax())
        if not len(left):
            return roots
    words = int(np.clip(2 ** np.ceil(np.log2(size.max() / 16 + 1)), 4, 1024))
    a, b = candidates(np.stack([bitmap(x, words) for x in sets]), size, forest.labels(), percent)
    if len(a):
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        for x, others in zip(*_runs(a, b)):
            apart = np.array([y for y in others if forest.find(int(y)) != forest.find(int(x))], dtype=np.int64)
            for y in linked(int(x), apart) if len(apart) else ():
                forest.join(int(x), int(y))
    return forest.labels()


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    x, at = np.unique(a, return_index=True)
    return x, np.split(b, at[1:])


def _calls(members: DataFrame, keys: list[str], rows: int, *columns: str):  # noqa: ANN202
    """members grouped for applyInPandas. Groups of keys are small as a rule, so several share a call: about CALL rows of rows, besides one group of BLOCK."""
    cell = F.xxhash64(*keys)
    calls = max(1, -(-rows // CALL))
    return members.select(cell.alias("cell"), F.pmod(F.xxhash64(cell), F.lit(calls)).alias("call"), "class_id", *columns).groupBy("call")


def _by_cell(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    frame = frame.sort_values(["cell", "class_id"]).drop_duplicates(["cell", "class_id"])
    cells, at = frame["cell"].to_numpy(), 0
    for end in [*(np.flatnonzero(np.diff(cells)) + 1), len(cells)] if len(cells) else []:
        if end - at > 1:
            yield frame.iloc[at:end]
        at = end


def _links(members: DataFrame, keys: list[str], percent: int, rows: int) -> DataFrame:
    """members (keys, class_id, tokens), about rows of them -> links (a, b) that connect what each group connects."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for own in _by_cell(frame):
            ids = own["class_id"].to_numpy()
            root = connect([np.frombuffer(t, dtype=np.uint64) for t in own["tokens"]], percent)
            far = np.flatnonzero(root != np.arange(len(ids)))
            a.append(ids[root[far]])
            b.append(ids[far])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _calls(members, keys, rows, "tokens").applyInPandas(of, "a long, b long")


def _promising(members: DataFrame, keys: list[str], percent: int, rows: int) -> DataFrame:
    """members (keys, class_id, size, bits) -> (cell, class_id): those whose bitmaps leave room for a link inside their group; cell is a hash of keys."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        out = [own[promising([np.frombuffer(x, dtype=np.uint64) for x in own["bits"]], own["size"].to_numpy(), percent)][["cell", "class_id"]] for own in _by_cell(frame)]
        return pd.concat(out) if out else pd.DataFrame({"cell": np.empty(0, np.int64), "class_id": np.empty(0, np.int64)})

    return _calls(members, keys, rows, "size", "bits").applyInPandas(of, "cell long, class_id long")


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, hash (of the text), n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id reachable by links)."""
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash")).alias("row"), "text")
    sets = materialise(_sets(own, n, percent, _frequencies(own, n)), "sets")
    full = sets.where("n_shingles > 0 and row.doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("row.doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.min_by(F.struct("prefix", "bits"), "row.doc_id").alias("own"))
    # a number for each class, stored, as ids may name several sets
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("class_id"), "*"), "classes")
    tokens = classes.select("class_id", "size", F.posexplode("own.prefix").alias("pos", "token"))
    shared = materialise(tokens.groupBy("token").count().where("count > 1").select("token"), "shared")
    # sizes of linked sets lie in one class of the scale or in neighbouring ones; a cell holds two neighbouring classes
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9)
    near = tokens.join(bounded_broadcast(shared), "token").select("class_id", "size", "pos", F.explode(F.array(F.xxhash64("token", step), F.xxhash64("token", step + 1))).alias("token"))
    near = materialise(near, "near")
    # Of two linked classes, the smaller has their first common shingle among its first a - ceil(2 t a / (1 + t)) + 1: what
    # they share lies from there on, and must make up the overlap that a link needs. A cell without such a member has no first common shingle.
    early = (100 + percent) * (F.col("size") - F.col("pos")) >= 2 * percent * F.col("size")
    mark = F.xxhash64("class_id")
    measure = (F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 16)).alias("s"), F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("both"), F.min(F.col("size") - F.col("pos")).alias("left"), F.max(early).alias("early"))
    fits = (100 * F.col("low") >= percent * F.col("high")) & ((100 + percent) * F.col("left") >= percent * F.col("both"))
    worth = F.col("early") & ((F.col("n") > 2) | ((F.col("n") == 2) & fits))
    groups = near.groupBy("token").agg(*measure).where(worth)
    # what a member has left must do for the smallest partner it may have; then the cells are counted again
    least = F.greatest(100 * F.col("low"), percent * F.col("size"))
    fit = near.join(bounded_broadcast(materialise(groups.select("token", "low"), "groups")), "token").where(100 * (100 + percent) * (F.col("size") - F.col("pos")) >= percent * (100 * F.col("size") + least))
    near = materialise(fit.select("token", "class_id", "size", "pos"), "near")
    groups = near.groupBy("token").agg(*measure).where(worth)
    cells = materialise(groups.groupBy("n", "x", "s").agg(F.min("token").alias("token")).select("token", "n"), "cells")
    members = materialise(near.join(bounded_broadcast(cells), "token").select("token", "n", "class_id"), "members")
    blocks = F.ceil(F.col("n") / block)
    small = members.where(F.col("n") <= block)
    large = members.where(F.col("n") > block).select("token", "class_id", blocks.cast("int").alias("k"), F.pmod(F.xxhash64("class_id"), blocks).cast("int").alias("block"))
    # Bitmaps first, in cells of up to a block: only members that may have a link there need their sets compared.
    rows = members.count()
    drawn = small.join(classes.select("class_id", "size", F.col("own.bits").alias("bits")), "class_id")
    small = materialise(_promising(drawn, ["token"], percent, rows), "promising").withColumnRenamed("cell", "token")
    firsts = large.groupBy("token", "k").agg(F.min("class_id").alias("class_id"))
    everywhere = firsts.select("token", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), "class_id")
    dealt = small.select("token", F.lit(-1).alias("block"), "class_id").union(large.select("token", "block", "class_id")).union(everywhere.select("token", "block", "class_id")).distinct()
    wanted = materialise(small.select("class_id").union(large.select("class_id")).distinct(), "wanted")
    named = materialise(classes.join(bounded_broadcast(wanted), "class_id").select("class_id", "digest", "first_id"), "named")
    chosen = own.join(bounded_broadcast(named.select("first_id").distinct()), F.col("row.doc_id") == F.col("first_id"), "left_semi").dropDuplicates(["row"])
    arrays = _arrays(chosen, n).join(bounded_broadcast(named.select("digest", "class_id")), "digest").select("class_id", "tokens")
    links = materialise(_links(dealt.join(arrays, "class_id"), ["token", "block"], percent, rows), "found")
    if not large.isEmpty():
        roots = materialise(components(links), "roots")
        root_of = lambda df: df.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
        first = root_of(firsts).select("token", F.col("root").alias("first"))
        rest = root_of(large).join(first, "token").where("root <> first")
        rest = materialise(rest.select("token", "class_id", "k", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("k")).cast("int").alias("part")), "rest")
        if not rest.isEmpty():
            parts = rest.select("token", "part").distinct()
            one = large.join(parts, "token").select("token", "block", "part", "class_id")
            two = rest.select("token", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), "part", "class_id")
            more = _links(one.union(two).distinct().join(arrays, "class_id"), ["token", "block", "part"], percent, rows)
            links = links.union(more)
    roots = components(links)
    inside = materialise(roots.join(classes.select(F.col("class_id").alias("node"), "first_id"), "node"), "inside")
    lowest = materialise(inside.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    named = inside.join(bounded_broadcast(lowest), "root").select(F.col("node").alias("class_id"), "component_id")
    named = classes.select("digest", "class_id", "first_id").join(named, "class_id", "left")
    named = named.select(F.col("digest").alias("d_"), F.col("first_id").alias("class_id"), F.coalesce("component_id", "first_id").alias("component_id"))
    discard(shared, near, cells, members, small, wanted)
    out = sets.select("row.*", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("row.doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(named, F.col("digest") == F.col("d_"), "left")
    return out.select("doc_id", "hash", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their component; rows of the component's smallest id stay."""
    found = similar_documents(docs, n, percent)
    gone = materialise(found.where("doc_id <> component_id").select(F.struct("doc_id", "hash").alias("m_gone")).distinct(), "gone")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash")).alias("key"))
    return packed.join(bounded_broadcast(gone), F.col("key") == F.col("m_gone"), "left_anti").select("row.*")
