"""Words and their hashes, for the operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: A-Z to a-z; other bytes, UTF-8 sequences among them, stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of text that are handled at once.
CHUNK = 2_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and UTF-8 texts (null: empty) of batches (doc_id, text), in pieces of about CHUNK bytes or one text."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        at, size = 0, 0
        for k, t in enumerate(texts):
            texts[k] = t = t or b""
            size += len(t)
            if size >= CHUNK:
                yield ids[at : k + 1], texts[at : k + 1]
                at, size = k + 1, 0
        if at < len(ids):
            yield ids[at:], texts[at:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False).astype(np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; a text of fewer words has one shingle, a text of none has none.

    Words are split at ASCII white space and lower-cased A-Z.
    """
    split = [t.translate(LOWER).split() for t in texts]
    lengths = np.array([len(w) for w in split])
    h = word_hashes([w for ws in split for w in ws])
    out, at = [], 0
    with np.errstate(over="ignore"):
        whole = h[: max(0, len(h) - n + 1)] * _ODD[0]
        for k in range(1, n):
            whole = whole + h[k : len(h) - n + 1 + k] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
        whole = mix(whole) if len(h) >= n else whole
        for m in lengths:
            if m >= n:
                out.append(np.unique(whole[at : at + m - n + 1]))
            elif m:
                few = np.uint64(m)
                for k in range(m):
                    few = few * _ODD[1] + h[at + k] * _ODD[k % 5]
                out.append(mix(np.array([few], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += m
    return out
