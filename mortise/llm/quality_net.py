"""Operator 7: a byte-level convolutional network in numpy that rates the quality of texts.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by WIDTH - 1, so that every window of WIDTH bytes lies whole in some chunk and
the chunks cover the whole text. FILTERS learned filters run over each chunk at every byte (STRIDE is 1); a filter
is a table of 256 values for each of its WIDTH offsets, that is a convolution over one-hot bytes. Each filter's outputs are rectified
and max-pooled in the chunk; the text has the maxima and the means of its chunks' pooled values, and the logarithm of
its length; a logistic unit makes one probability of them.

Filters and unit are fitted together by Adam on the logistic loss, with gradients through the pooled maxima. Labels come from rows whose
crc32(doc_id) mod 5 is not 0, at most TRAIN_ROWS of them in hash order (a parameter). Fitting and scoring cover every chunk of every
row they have. Null and empty texts are one chunk of
blanks. Repeated and null ids are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mortise.llm.toxicity import fold, training_rows
from mortise.llm.words import chunks

CHUNK, WIDTH, STRIDE, FILTERS = 512, 6, 1, 16
TRAIN_ROWS = 3_000
PASSES, RATE = 8, 0.01


def pieces(text: bytes) -> np.ndarray:
    """The chunks of a text, one a row; the last is filled with blanks, and a text of one chunk repeats no byte."""
    step = CHUNK - WIDTH + STRIDE
    n = max(1, -(-(len(text) - CHUNK) // step) + 1)
    flat = np.full((n - 1) * step + CHUNK, 32, dtype=np.uint8)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


def outputs(x: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """chunks x windows x filters, before rectifying. Two offsets are looked up at once, as a pair of bytes."""
    pairs = (tables[0::2][:, :, None, :] + tables[1::2][:, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)
    wide = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    n = CHUNK - WIDTH + 1
    out = pairs[0][wide[:, :n]]
    for k in range(1, WIDTH // 2):
        out += pairs[k][wide[:, 2 * k : 2 * k + n]]
    return out + bias


def pooled(x: np.ndarray, pairs: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """chunks x filters: rectified maxima."""
    wide = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    n = CHUNK - WIDTH + 1
    out = np.take(pairs[0], wide[:, :n], axis=0)
    for k in range(1, WIDTH // 2):
        out += np.take(pairs[k], wide[:, 2 * k : 2 * k + n], axis=0)
    return np.maximum(out.max(1) + bias, 0)


def describe(p: np.ndarray, n_bytes: int) -> np.ndarray:
    return np.concatenate((p.max(0), p.mean(0), [np.log1p(n_bytes) / 10]))


class Net:
    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.tables = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.unit = r.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)

    def scorer(self):  # noqa: ANN201
        pairs = [(self.tables[k][:, None, :] + self.tables[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

        def score(text: bytes) -> float:
            x = pieces(text)
            p = np.concatenate([pooled(x[k : k + 32], pairs, self.bias) for k in range(0, len(x), 32)])
            z = float(describe(p, len(text)) @ self.unit + self.shift[0])
            return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

        return score


def train(texts: list[bytes], labels: np.ndarray, passes: int = PASSES) -> Net:
    """Adam over batches of 32 texts."""
    net, r = Net(), np.random.default_rng(2)
    if not len(labels):
        return net
    rate = float(np.clip(labels.mean(), 0.01, 0.99))
    net.shift[:] = np.log(rate / (1 - rate))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(net).items()}
    cut = [pieces(t) for t in texts]
    t = 0
    for step in range(passes):
        for batch in np.array_split(r.permutation(len(texts)), max(1, len(texts) // 32)):
            x = np.concatenate([cut[k] for k in batch])
            at = np.concatenate(([0], np.cumsum([len(cut[k]) for k in batch])))
            where, p = [], []
            for k in range(0, len(x), 64):  # a long text's chunks in parts, for bounded memory
                out = outputs(x[k : k + 64], net.tables, net.bias)
                where.append(out.argmax(1))  # chunks x filters
                p.append(np.maximum(np.take_along_axis(out, where[-1][:, None, :], 1)[:, 0], 0))
            where, p = np.concatenate(where), np.concatenate(p)
            feats = np.stack([describe(p[a:b], len(texts[k])) for a, b, k in zip(at[:-1], at[1:], batch, strict=True)])
            prob = 1 / (1 + np.exp(-np.clip(feats @ net.unit + net.shift[0], -30, 30)))
            dz = (prob - labels[batch]) / len(batch)
            grads = {"unit": feats.T @ dz + 1e-4 * net.unit, "shift": np.array([dz.sum()])}
            dp = np.zeros_like(p)
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                dp[a + p[a:b].argmax(0), np.arange(FILTERS)] += dz[k] * net.unit[:FILTERS]
                dp[a:b] += dz[k] * net.unit[FILTERS : 2 * FILTERS] / (b - a)
            dp *= p > 0
            dt = np.zeros_like(net.tables)
            rows, cols = np.nonzero(dp)
            for o in range(WIDTH):
                np.add.at(dt[o], (x[rows, where[rows, cols] * STRIDE + o], cols), dp[rows, cols])
            grads |= {"tables": dt, "bias": dp.sum(0)}
            t += 1
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, k)[...] -= RATE * (1 - step / passes * 0.9) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted (score 0.3 or more)."""
    texts, y = training_rows(docs, labels, "quality", rows)
    net = docs.sparkSession.sparkContext.broadcast(train([t.encode() for t in texts], y))  # WIDTH x 256 x FILTERS numbers

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.value.scorer()
        for ids, some in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([score(t) for t in some], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
