"""The fit against a plain minimiser, the query against plain scoring, and words of every script."""

import math
import random
import zlib

import numpy as np

from kinweave.llm import registry, toxicity


def objective(w, rows, m):
    """Log loss + RIDGE |w|^2 + FAIRNESS * mean squared gap, with its gradient, one row at a time."""
    total, grad = toxicity.RIDGE * float(w[:m] @ w[:m]), np.append(2 * toxicity.RIDGE * w[:m], 0.0)
    pairs = [(own, other) for _, own, swaps in rows for other in swaps]
    for y, own, _ in rows:
        z = float(w[own].sum() + w[m])
        total += (math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z) / len(rows)
        e = (1 / (1 + math.exp(-z)) - y) / len(rows)
        grad[own] += e
        grad[m] += e
    for own, other in pairs:
        gap = float(w[own].sum() - w[other].sum())
        total += toxicity.FAIRNESS * gap * gap / len(pairs)
        grad[own] += 2 * toxicity.FAIRNESS * gap / len(pairs)
        grad[other] -= 2 * toxicity.FAIRNESS * gap / len(pairs)
    return total, grad


def minimum(rows, m):
    """Newton's method on the convex objective, with the Hessian by its definition."""
    w = np.zeros(m + 1)
    unit = lambda own, bias: np.bincount(own, minlength=m + 1).astype(float) + (np.arange(m + 1) == m) * bias
    xs = [unit(own, 1.0) for _, own, _ in rows]
    gaps = [unit(own, 0.0) - unit(other, 0.0) for _, own, swaps in rows for other in swaps]
    for _ in range(40):
        _, grad = objective(w, rows, m)
        h = np.diag(np.append(np.full(m, 2 * toxicity.RIDGE), 1e-9))
        for x in xs:
            p = 1 / (1 + math.exp(-float(w @ x)))
            h += p * (1 - p) / len(rows) * np.outer(x, x)
        for d in gaps:
            h += 2 * toxicity.FAIRNESS / len(gaps) * np.outer(d, d)
        w = w - np.linalg.solve(h, grad)
    return w, objective(w, rows, m)[0]


def test_fit_reaches_the_minimum():
    r = random.Random(2)
    rows = []
    for _ in range(150):
        own = sorted(r.sample(range(2, 20), 4))
        toxic = int(5 in own or r.random() < 0.1)
        if r.random() < (0.7 if toxic else 0.2):  # features 0 and 1 are the terms of a group
            own = [0, *own]
        rows.append((toxic, own, [[1, *own[1:]], own[1:]] if own[0] == 0 else []))
    model = toxicity.fit(rows, np.arange(20))
    w, best = minimum(rows, 20)
    got = np.array([model.weights.get(i, 0.0) for i in range(20)] + [model.bias])
    value, _ = objective(got, rows, 20)
    assert value <= best * 1.03 + 1e-3
    apart = [abs(1 / (1 + math.exp(-(got[own].sum() + got[20]))) - 1 / (1 + math.exp(-(w[own].sum() + w[20])))) for _, own, _ in rows]
    assert np.mean(apart) < 0.02, (value, best, np.mean(apart), max(apart))
    assert abs(got[0] - got[1]) < 0.1 and got[5] > 1


def test_query_by_plain_scoring(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {}
    for r in docs.collect():
        features = {f for w in toxicity.words(r.text) for f in toxicity.word_features(w)}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in features)
        want[r.doc_id] = 1 / (1 + math.exp(-min(30, max(-30, z))))
    got = registry.op6_toxicity(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_words_of_every_script():
    assert toxicity.words("Étrangers, JUDÍOS! (Ausländer)\tΣΟΦΙΑ") == {w.encode() for w in ("étrangers", "judíos", "ausländer", "σοφια")}
    assert toxicity.words(None) == toxicity.words(" \n ") == set()
