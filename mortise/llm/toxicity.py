"""Operator 6: toxicity by weak supervision.

1. Tokens of a text: its distinct words (lower-cased letters), their beginnings of 4 to 7 letters ("ab-"), both once more
   with a mark for each density they reach ("ab-^": half a percent of the words, "ab-^^": one percent), and pattern marks.
2. Voters are mined from labelled rows: single tokens (a lexicon voter each) that are far more frequent in toxic than in other
   texts, and the fixed patterns. A voter says "toxic" where its token occurs, and abstains elsewhere. One more voter
   says "clean" where all others abstain.
3. The label model is generative: a class prior, and for each voter the rates at which it fires in either class, fitted by
   expectation-maximisation on the votes alone; no row's own label is a vote. Voters are correlated (a word fires with its
   beginnings); given the class, the model estimates correlations from the votes and divides a voter's evidence by the
   sum of its positive correlations, so that a clique of copies counts once. Voters whose estimated accuracy is under
   LEAST_ACCURACY are left out, and the model is fitted again.
4. A linear classifier over the tokens is fitted to the posterior labels, by logistic regression until its gradient vanishes, and scores every text whole.

Labels come from rows whose crc32(doc_id) mod 5 is not 0, at most TRAIN_ROWS of them (in hash order, so a
documented, bounded sample); voter mining, label model and fitting hold no more. Scoring covers every row. Null and
empty texts get the score of a text without tokens; very long ones are read whole. Duplicate and null ids are scored row by row; null ids
are never trained on. Of several labels or texts of one id, training takes the largest. Empty tables give empty results, or a
constant score without labels. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from mortise.llm.words import chunks

TRAIN_ROWS = 6_000
VOTERS = 300
FEATURES = 4_000
LEAST_ACCURACY = 0.5
_WORD = re.compile(r"[^\W\d_]+")
# Surface patterns that accompany abuse in any language.
PATTERNS = {
    "*shouting": regex.compile(r"(?:\b\p{Lu}{4,}\b\W+){4}"),
    "*exclaims": regex.compile(r"!{2,}"),
    "*you_are": regex.compile(r"(?i)\b(?:you are|you're|tu es|du bist|eres) (?:an? |une? |ein )?\p{L}+"),
    "*masked": regex.compile(r"\p{L}[*@#$]{2,}\p{L}"),
}


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def tokens(text: str) -> list[str]:
    words = Counter(_WORD.findall(text.lower()))
    n = words.total()
    starts: Counter = Counter()
    for w, c in words.items():
        for k in range(4, min(8, len(w) + 1)):
            starts[w[:k] + "-"] += c
    out = [name for name, p in PATTERNS.items() if p.search(text)]
    for counts in (words, starts):
        out += counts
        dense = [t for t, c in counts.items() if 200 * c >= n]
        out += [t + "^" for t in dense]
        out += [t + "^^" for t in dense if 100 * counts[t] >= n]
    return out


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """votes (rows x voters, 0 or 1; the last voter says "clean", the others "toxic"), share of toxic rows -> the posterior of each row, and each voter's accuracy (share of its votes that are right).

    No row's label takes part: the first guess is that the rows with most votes are toxic, as many of them as the prior says.
    """
    m = votes.shape[1]
    load = votes[:, :-1].sum(1)
    p = np.where(load > max(1.0, float(np.quantile(load, 1 - prior))), 0.9, 0.5 * prior)
    discount = np.ones(m)
    for k in range(rounds):
        one, two = p.sum(), (1 - p).sum()
        fire1 = np.clip((votes.T @ p + 0.5 * prior) / (one + 1), 1e-4, 1 - 1e-4)
        fire0 = np.clip((votes.T @ (1 - p) + 0.5) / (two + 1), 1e-5, 1 - 1e-4)
        if k % 10 == 0:  # correlations of the voters within the classes
            rest = votes - np.outer(p, fire1) - np.outer(1 - p, fire0)
            c = rest.T @ rest
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            c = c / d[:, None] / d[None, :]
            discount = 1 / np.where(c > 0.35, c, 0).sum(1).clip(1)
        score = np.log(prior / (1 - prior)) + votes @ (np.log(fire1 / fire0) * discount)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    right = votes.T @ p
    right[-1] = (votes.T @ (1 - p))[-1]
    return p, right / np.maximum(votes.sum(0), 1)


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: float = 20.0, ridge: float = 0.02, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and bias with the least weight * (mean cross-entropy to target, which may be soft) + ridge / 2 * |w|^2.

    Limited-memory quasi-Newton steps with a line search, until the gradient is under 1e-6 of its start. The objective is strictly convex
    in w, so where the fit ends does not depend on its path.
    """
    n, m = x.shape
    x = x.astype(np.float64)
    shrink = np.append(np.full(m, ridge), 0.0)  # the bias is free

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ v[:-1] + v[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        loss = weight * (np.logaddexp(0, z) - target * z).mean() + 0.5 * (shrink * v * v).sum()
        rest = weight * (p - target) / n
        return float(loss), np.append(x.T @ rest, rest.sum()) + shrink * v

    mean = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    v = np.append(np.zeros(m), np.log(mean / (1 - mean)))
    loss, g = at(v)
    stop, past = 1e-6 * float(np.abs(g).max()), []
    for _ in range(rounds):
        if np.abs(g).max() <= stop:
            break
        d, kept = -g, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ d))
            d = d - kept[-1] * y
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, y, r), k in zip(past, reversed(kept), strict=True):
            d = d + s * (k - r * (y @ d))
        slope, step = float(g @ d), 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(g)))
        while (new := at(v + step * d))[0] > loss + 1e-4 * step * slope and step > 1e-12:
            step /= 2
        if step <= 1e-12:
            break  # no lower value in floating point
        s, y = step * d, new[1] - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            past = [*past[-19:], (s, y, 1 / (s @ y))]
        v, loss, g = v + s, *new
    return v[:-1], float(v[-1])


def train(texts: list[str], labels: np.ndarray) -> tuple[dict[str, float], float]:
    """The classifier: token weights and a bias."""
    if not len(labels) or labels.min() == labels.max():
        return {}, float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))) if len(labels) else 0.0
    bad, good = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        if y:
            bad.update(tokens(t))
    bad = Counter({t: c for t, c in bad.items() if c >= 3})
    for t, y in zip(texts, labels, strict=True):
        if not y:
            good.update(x for x in tokens(t) if x in bad)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    # a cautious log-odds: what the token's rates say after adding pseudo-counts
    gain = {t: np.log((c + 0.5) / (n1 + 1)) - np.log((good[t] + 1.5) / (n0 + 3)) for t, c in bad.items()}
    strong = sorted((t for t in gain if gain[t] > 1.5), key=lambda t: (-bad[t] * gain[t] / (1 + good[t]), t))
    voters = strong[:VOTERS] + [p for p in PATTERNS if p not in strong[:VOTERS] and gain.get(p, 0) > 0.7]
    names = voters + [t for t in sorted(gain, key=lambda t: (-bad[t] * max(gain[t], 0), t)) if t not in set(voters)][: FEATURES - len(voters)]
    at = {t: k for k, t in enumerate(names)}
    x = np.zeros((len(texts), len(names)), dtype=np.float32)
    for r, text in enumerate(texts):
        x[r, [at[t] for t in tokens(text) if t in at]] = 1
    votes = x[:, : len(voters)].astype(np.float64)
    prior = float(np.clip(labels.mean(), 0.01, 0.5))
    _, accuracy = label_model(np.column_stack((votes, votes.sum(1) == 0)), prior)
    votes = votes[:, accuracy[:-1] >= LEAST_ACCURACY]  # voters that the model finds no better than a guess are left out
    posterior, _ = label_model(np.column_stack((votes, votes.sum(1) == 0)), prior)
    w, b = fit_logistic(x, posterior)
    keep = np.abs(w) > 1e-3
    return {t: float(v) for t, v, k in zip(names, w, keep, strict=True) if k}, float(b)


class Scorer:
    """The classifier applied to texts; equals a sum over tokens(), but looks only at tokens with a weight."""

    REMEMBERED = 300_000

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.stems = {t.rstrip("^") for t in weights}
        self.patterns = [n for n in PATTERNS if n in weights]
        self.known: dict[str, tuple[str, ...]] = {}

    def stems_of(self, word: str) -> tuple[str, ...]:
        if len(self.known) >= self.REMEMBERED:
            self.known.clear()
        own = [word, *(word[:k] + "-" for k in range(4, min(8, len(word) + 1)))]
        self.known[word] = out = tuple(t for t in own if t in self.stems)
        return out

    def __call__(self, text: str) -> float:
        words = Counter(_WORD.findall(text.lower()))
        n, found, known = words.total(), {}, self.known
        for w, c in words.items():
            for t in known[w] if w in known else self.stems_of(w):
                found[t] = found.get(t, 0) + c
        z, get = self.bias, self.weights.get
        for t, c in found.items():
            z += get(t, 0.0)
            if 200 * c >= n:
                z += get(t + "^", 0.0)
                if 100 * c >= n:
                    z += get(t + "^^", 0.0)
        z += sum(self.weights[p] for p in self.patterns if PATTERNS[p].search(text))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def score(text: str, weights: dict[str, float], bias: float) -> float:
    """The score as defined: every token of the text, with its weight."""
    z = bias + sum(weights[t] for t in tokens(text) if t in weights)
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> tuple[list[str], np.ndarray]:
    """At most rows texts with their labels, none of them held out."""
    known = labels.where(F.col(column).isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(column).alias("y"))
    some = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    found = sorted(got.toLocalIterator(), key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in found], np.array([r["y"] for r in found], dtype=np.int64)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels, "toxic", rows)))  # FEATURES weights at most

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*model.value)
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([score(t.decode()) for t in texts], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
