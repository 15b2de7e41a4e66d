"""The toxicity classifier: a converged fit, over several corpora."""

import numpy as np
import pytest

from mortise.llm import toxicity


def newton(x, target, weight=20.0, ridge=0.02):
    """A plain reference fit."""
    n, m = x.shape
    a = np.column_stack((x, np.ones(n)))
    shrink = np.append(np.full(m, ridge), 0.0)
    v = np.zeros(m + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ v))
        g = a.T @ (p - target) * weight / n + shrink * v
        v -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a * weight / n + np.diag(shrink) + 1e-12 * np.eye(m + 1), g)
    return v[:-1], v[-1]


@pytest.mark.parametrize("seed", range(4))
def test_fit_equals_newton(seed):
    r = np.random.default_rng(seed)
    x = (r.random((300, 40)) < 0.2).astype(np.float32)
    target = np.clip(1 / (1 + np.exp(-(x @ r.normal(0, 2, 40)))) + r.normal(0, 0.05, 300), 0, 1)
    (w, b), (w2, b2) = toxicity.fit_logistic(x, target), newton(x.astype(float), target)
    assert np.abs(w - w2).max() < 1e-3 and abs(b - b2) < 1e-3


@pytest.mark.parametrize("seed", range(8))
def test_clear_cut_corpora_of_any_seed(seed):
    r = np.random.default_rng(seed)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [" ".join(r.choice(vocab, 60)) + (" you awful scoundrel" if i % 3 == 0 else "") for i in range(300)]
    weights, bias = toxicity.train(texts[:250], np.array([int(i % 3 == 0) for i in range(250)]))
    score = toxicity.Scorer(weights, bias)
    assert all((score(t) >= 0.5) == (i % 3 == 0) for i, t in enumerate(texts))
    assert all(abs(score(t) - toxicity.score(t, weights, bias)) < 1e-9 for t in texts[:20])


def test_edges(spark):
    schema, y = "doc_id long, text string, source string", spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, "you vile creature go" if i % 2 else "a calm day out", "s") for i in range(40)]
    got = toxicity.score_documents(spark.createDataFrame([*rows, (1, "a calm day out", "t"), (None, None, None), (None, "vile", None), (99, "", "s")], schema), y)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 44  # repeated and null ids are rows of their own
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    assert toxicity.score_documents(spark.createDataFrame([], schema), y).collect() == []
    none = toxicity.score_documents(spark.createDataFrame(rows, schema), spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in none.collect()}) == 1
