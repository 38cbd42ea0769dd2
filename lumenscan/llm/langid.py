"""Language identification by hierarchical discrimination.

A text is described by the share of each hashed byte 1-, 2-, 3- and 4-gram. Linear support
vector machines, one versus one, first choose the language family, then the language within
it, where close relatives differ. A linear score is the mean weight of the text's grams, so
whole texts of any length are scored by lookups, without building their vectors.

The fit sees a bounded sample (``max_rows``) drawn by hash; scoring is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Language families by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
}
DIMS = 4096


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _lower(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, digits alike, runs of other ASCII as they are."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    out[(raw >= 48) & (raw <= 57)] = 48
    return out


def grams(raw: np.ndarray, dims: int = DIMS) -> list[np.ndarray]:
    """Hash slots of the 1- to 4-grams that end at each byte (bytes before the start count as zero)."""
    b = np.concatenate([np.zeros(3, dtype=np.uint32), _lower(raw).astype(np.uint32)])
    key, out = np.zeros(len(raw), dtype=np.uint32), []
    for k in range(4):
        key = (key + b[3 - k : len(b) - k] + np.uint32(1 + k)) * np.uint32(0x9E3779B1)
        out.append(((key ^ (key >> np.uint32(15))) % np.uint32(dims)).astype(np.int64))
        key ^= key >> np.uint32(16)
    return out


def shares(text: str, dims: int = DIMS) -> np.ndarray:
    raw = np.frombuffer(f" {text} ".encode(), dtype=np.uint8)
    return (np.bincount(np.concatenate(grams(raw, dims)), minlength=dims) / (4 * len(raw))).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, *, cost: float = 10.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss: accelerated gradient descent; y is -1 or 1, classes count alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * cost
    xb = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    v = np.ones(xb.shape[1], dtype=np.float32)
    for _ in range(12):  # largest curvature
        v = xb.T @ (weight * (xb @ v))
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    rate = float(1 / (2 * size + 1.0))
    w = np.zeros(xb.shape[1], dtype=np.float32)
    z, t = w.copy(), 1.0  # plain floats throughout: a wider number would widen the matrix at each step
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ z))
        grad = z - 2 * xb.T @ (weight * y * slack)
        new = z - rate * grad
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """families: each with its languages. pairs: (node, a, b), where node is None for families."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple] = field(default_factory=list)
    weights: np.ndarray | None = None  # (dims, pairs)
    bias: np.ndarray | None = None

    def _pieces(self, texts: list[str]):
        """A few MB of texts at a time: first and last text, the grams' slots, each text's bounds in them and its bytes."""
        raws = [f" {t} ".encode() for t in texts]
        sizes = np.array([len(r) for r in raws])
        first = 0
        while first < len(raws):
            last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), 2_000_000)) + first)
            # Three zero bytes before each text stand for "no byte", as at the start of a text alone.
            n = sizes[first:last]
            ends = np.cumsum(n + 3)
            slots = grams(np.frombuffer(b"".join(b"\0\0\0" + r for r in raws[first:last]), dtype=np.uint8), len(self.weights))
            yield first, last, slots, ends - n, n
            first = last

    def _sums(self, slots, starts: np.ndarray, n: np.ndarray, pairs: list[int]) -> np.ndarray:
        """The margins of some pairs for the texts that stand at ``starts`` and are ``n`` bytes long."""
        out = np.empty((len(n), len(pairs)))
        bounds = np.stack([starts, starts + n], 1).ravel()
        for at, k in enumerate(pairs):
            w = self.weights[:, k]
            total = w[slots[0]]
            for s in slots[1:]:
                total = total + w[s]
            out[:, at] = np.add.reduceat(np.append(total, 0), bounds, dtype=np.float64)[::2] / (4 * n) + self.bias[k]
        return out

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margins of all pairs."""
        every = list(range(len(self.pairs)))
        if not every or not texts:
            return np.zeros((len(texts), len(every)))
        return np.concatenate([self._sums(slots, starts, n, every) for _, _, slots, starts, n in self._pieces(texts)])

    def _choose(self, names: list[str], pairs: list[int], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's place in ``names`` by votes, then margins, then the alphabet; its share of softened votes.
        ``margins``: a column for each of ``pairs``."""
        votes, soft = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        at = {n: i for i, n in enumerate(names)}
        for column, k in enumerate(pairs):
            _, a, b = self.pairs[k]
            p = 1 / (1 + np.exp(-np.clip(4 * margins[:, column], -30, 30)))
            votes[:, at[a]] += p > 0.5
            votes[:, at[b]] += p <= 0.5
            soft[:, at[a]] += p
            soft[:, at[b]] += 1 - p
        best = np.argmax(votes + soft / (len(names) + 1), axis=1)
        share = soft[np.arange(len(soft)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(soft))
        return best, share

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The family of each text, then its language by the pairs of that family alone."""
        names = sorted(self.families)
        if not names:
            return ["und"] * len(texts), np.zeros(len(texts))
        of = {node: [k for k, p in enumerate(self.pairs) if p[0] == node] for node in (None, *names)}
        out, score = [""] * len(texts), np.ones(len(texts))
        if not self.pairs:
            return [self.families[names[0]][0]] * len(texts), score
        for first, last, slots, starts, n in self._pieces(texts):
            family, score[first:last] = self._choose(names, of[None], self._sums(slots, starts, n, of[None]))
            for f, name in enumerate(names):
                rows = np.flatnonzero(family == f)
                if not len(rows):
                    continue
                if of[name]:
                    # The bytes of these texts, moved together.
                    keep = np.repeat(starts[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(int(n[rows].sum()))
                    best, share = self._choose(self.families[name], of[name], self._sums([s[keep] for s in slots], np.cumsum(n[rows]) - n[rows], n[rows], of[name]))
                    score[first + rows] *= share
                else:
                    best = np.zeros(len(rows), dtype=int)
                for i, b in zip(rows.tolist(), best.tolist(), strict=True):
                    out[first + i] = self.families[name][b]
        return out, score


FEW = 12


def families_of(x: np.ndarray, langs: np.ndarray) -> dict[str, list[str]]:
    """The languages by family. Those of no listed family are families of their own while they are FEW; else they are put
    together by likeness: halved at the middle of their means' main direction until no part is larger than the square root of
    their number. So pairs of families, and of languages in them, stay far fewer than pairs of languages."""
    out: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        out.setdefault(family_of(lang), []).append(lang)
    alone = [f for f in out if f not in FAMILIES]
    if len(alone) <= FEW:
        return out
    means = {f: x[langs == f].mean(0) for f in alone}
    for f in alone:
        del out[f]
    todo, most = [alone], max(2, math.isqrt(len(alone)))
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out[f"like {own[0]}"] = sorted(own)
            continue
        at = np.stack([means[f] for f in own])
        at -= at.mean(0)
        main = np.linalg.svd(at, full_matrices=False)[2][0]
        main *= np.sign(main[np.argmax(np.abs(main))]) or 1.0
        order = [own[i] for i in np.argsort(at @ main, kind="stable")]
        todo += [sorted(order[: len(order) // 2]), sorted(order[len(order) // 2 :])]
    return out


def fit_rows(x: np.ndarray, langs: np.ndarray) -> Model:
    m = Model(families_of(x, langs))
    scale = 1 / (x.std(0) + 1e-5)
    of = {lang: f for f, own in m.families.items() for lang in own}
    family = np.array([of[x] for x in langs])
    jobs = [(None, a, b, family) for a, b in combinations(sorted(m.families), 2)]
    jobs += [(f, a, b, langs) for f, own in m.families.items() for a, b in combinations(own, 2)]
    w, bias = [], []
    for node, a, b, by in jobs:
        rows = (by == a) | (by == b)
        # Dividing by the number of features keeps a vector's length near one.
        own, c = fit_svm(x[rows] * (scale * len(scale) ** -0.5), np.where(by[rows] == a, 1.0, -1.0).astype(np.float32))
        m.pairs.append((node, a, b))
        w.append(own * scale * len(scale) ** -0.5)
        bias.append(c)
    if w:
        m.weights, m.bias = np.ascontiguousarray(np.stack(w, 1)), np.array(bias)
    return m


def fit(docs: DataFrame, *, learn=None, max_rows: int = 3000, least: int = 8, dims: int = DIMS) -> Model:
    """Fit on ``docs`` (text, lang). ``learn``: the rows that may be learnt from. About ``max_rows`` rows
    are used, as many of each language as there are, and of every language ``least`` where it has them: all values of lang are
    learnt. Without labelled rows the model knows no language."""
    with common.batches_of(docs.sparkSession, 1000):
        return _fit(docs, learn, max_rows, least, dims)


def _fit(docs: DataFrame, learn, max_rows: int, least: int, dims: int) -> Model:
    known = docs.filter((F.lit(True) if learn is None else learn) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model()
    # A language with few rows gives all of them, so that none is missed by chance.
    share = {k: 1.0 if n <= 4 * least else max(max_rows / len(sizes), 2 * least) / n for k, n in sizes.items()}
    (limit,) = common.fresh(docs, "l_limit")
    limits = docs.sparkSession.createDataFrame([(k, int(min(1.0, s) * 1_000_000)) for k, s in share.items()], f"lang string, {limit} int")
    some = known.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64(F.lit(5), *(c for c in ("doc_id", "text") if c in docs.columns)), F.lit(1_000_000)) < F.col(limit))

    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "x": [shares(t, dims).tobytes() for t in b["text"]]})

    got = some.select("lang", "text").mapInPandas(rows, "lang string, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), dims)
    return fit_rows(x, got["lang"].to_numpy())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (new names if taken). Null text and text without a letter
    are ``und`` with score 0. Equal texts get equal languages; other columns are kept as they are."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def ask(texts: pd.Series) -> pd.DataFrame:
        langs, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": score})

    name, score, both = common.fresh(docs, "lang_pred", "lang_score", "lang_both")
    text, spoken = F.col(text_col), has_letter(F.col(text_col))
    out = docs.withColumn(both, ask(common.text_of(text_col)))
    return out.withColumn(name, F.when(spoken, F.col(both + ".lang")).otherwise("und")).withColumn(
        score, F.when(spoken, F.col(both + ".score")).otherwise(0.0)).drop(both)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, learn=common.fold("doc_id", 4) != 2)
    done = predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
