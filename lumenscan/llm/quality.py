"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives (labels of quality 1) and unlabelled documents train a small network on
counts taken from the whole text. With p the class prior, the risk of the unlabelled rows
being negative less p times that of the positives is an unbiased estimate of the negatives'
risk; as a true risk cannot be below zero, steps that push it there are turned around.
The logistic loss makes the output a probability. The class prior comes from the same two sets: a
classifier that tells trusted from unlabelled rows ranks held-back rows of both, and the share of
unlabelled rows above a threshold, over that of trusted ones, is least where only positives stand.
Labels of 0 are never read.

The fit sees bounded samples (``max_rows`` of each kind) drawn by hash over the whole table;
scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PUNCTUATION = np.frombuffer(string.punctuation.encode(), dtype=np.uint8)


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text: its make-up by kinds of characters, words and lines."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words = raw.split()
    n_words = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    n_lines = max(1, len(lines))
    longest = len(max(seen, key=len, default=b""))
    marks = counts[PUNCTUATION]
    out = np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(n_lines),
        upper / n, lower / n, digit / n, counts[128:].sum() / n, counts[32] / n, counts[10] / n, marks.sum() / n,
        upper / max(1, upper + lower), marks.sum() / n_words, len(raw) / n_words, np.log1p(longest),
        len(seen) / n_words, np.log1p(len(seen)) / np.log1p(n_words) if words else 0.0,
        max(seen.values(), default=0) / n_words, sum(map(eq, words, words[1:])) / n_words,
        len(set(lines)) / n_lines, np.log1p(n / n_lines),
    ])
    return np.concatenate([out, np.sqrt(marks / n)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        w1, b1, w2, b2 = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ w1 + b1) @ w2 + b2, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = 24, epochs: int = 60, rate: float = 5e-3, decay: float = 1e-4, batch: int = 512, seed: int = 11) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by Adam."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, p.shape[1] ** -0.5, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    steps = max(1, max(len(p), len(u)) // batch)
    for epoch in range(epochs):
        lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        for _ in range(steps):
            xp, xu = p[rng.integers(0, len(p), min(batch, len(p)))], u[rng.integers(0, len(u), min(batch, len(u)))]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ layers[0] + layers[1])
            g = np.clip(h @ layers[2] + layers[3][0], -30, 30)
            s = 1 / (1 + np.exp(-g))
            k = len(xp)
            # Loss of calling g positive: log(1 + exp(-g)), slope s - 1; negative: log(1 + exp(g)), slope s.
            negative = np.logaddexp(0, g[k:]).mean() - prior * np.logaddexp(0, g[:k]).mean()
            slope = np.zeros_like(g)
            if negative >= 0:
                slope[:k] = prior * ((s[:k] - 1) - s[:k]) / k
                slope[k:] = s[k:] / len(xu)
            else:
                slope[:k] = prior * s[:k] / k
                slope[k:] = -s[k:] / len(xu)
            back = slope[:, None] * layers[2] * (1 - h * h)
            grads = [x.T @ back + decay * layers[0], back.sum(0), h.T @ slope + decay * layers[2], np.array([slope.sum()])]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                layers[i] = layers[i] - lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, layers)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 300, seed: int = 5) -> float:
    """The share of positives among the unlabelled rows, by the best bin of a ranking: a logistic regression on
    one half of the rows ranks the other half; of all thresholds the one of least ratio, plus its
    margin of error, gives the share. Between 0.02 and 0.98."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    halves = []
    for x in (positive, unlabelled):
        z = np.clip((x - mean) / scale, -6, 6)[rng.permutation(len(x))]
        halves.append((z[: (len(z) + 1) // 2], z[len(z) // 2 :]))
    (p, p_held), (u, u_held) = halves
    x = np.concatenate([p, u])
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    weight = np.where(y > 0, 0.5 / len(p), 0.5 / len(u))
    w, b, speed = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        d = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        speed = 0.9 * speed - 0.2 * np.append(x.T @ d + 1e-3 * w, d.sum())
        w, b = w + speed[:-1], b + speed[-1]
    ranked = [np.sort(z @ w) for z in (p_held, u_held)]
    cuts = np.unique(ranked[0])
    above_p, above_u = (1 - np.searchsorted(r, cuts, side="left") / len(r) for r in ranked)
    error = sum(np.sqrt(np.log(40) / (2 * len(r))) for r in ranked)
    best = np.argmin((above_u + 1.01 * error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _sample(docs: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``rows`` rows, by hash."""
    return docs.filter(F.pmod(F.xxhash64(F.lit(3), *docs.columns), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(1, rows))))


def _matrix(texts: DataFrame) -> np.ndarray:
    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"x": [features(t).tolist() for t in b["text"]]})

    got = texts.select("text").mapInPandas(rows, "x array<double>").toPandas()["x"]
    return np.array(got.tolist()).reshape(len(got), len(features("")))


def fit(docs: DataFrame, labels: DataFrame, *, learn=None, max_rows: int = 20_000) -> Model | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality: 1 for trusted positives). ``learn``: the
    ids that may be learnt from. At most about ``max_rows`` positives and as many unlabelled rows are
    used; the class prior is estimated from them. Null ids and null labels tell nothing, repeated
    labels count once. None without positives."""
    learn = F.lit(True) if learn is None else learn
    with common.batches_of(docs.sparkSession, 1000):
        trusted = labels.filter(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        ones = trusted.count()
        if not ones:
            return None
        trusted = _sample(trusted, ones, max_rows)  # bounded by max_rows, so small enough to broadcast
        positive = _matrix(docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left_semi"))
        pool = docs.filter(learn).select("doc_id", "text")
        unlabelled = _matrix(_sample(pool, pool.count(), max_rows))
    if not len(positive) or not len(unlabelled):
        return None
    return fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))


def score_udf(model: Model | None):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.scores(np.stack([features(t) for t in texts])))

    return score


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1. Null text counts as empty; without a model every score is 0.5."""
    common.small_batches(docs.sparkSession)
    (name,) = common.fresh(docs, name)
    return docs.withColumn(name, score_udf(model)(F.col(text_col)))


def model_of(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The production model: one third of the ids is held out."""
    return fit(docs, labels, learn=common.fold("doc_id", 3) != 1)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of ``docs``."""
    scored = score(docs, model_of(docs, labels))
    return scored.filter(F.col(scored.columns[-1]) >= threshold).drop(scored.columns[-1])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), model_of(docs, common.table(spark, sf_dir, "labels")), name="score")
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
