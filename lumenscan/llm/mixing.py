"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document falls by hash into one block of its source, so a block is a random
(permuted) part of the source and needs no sort. A source's target turns into an exact
quota of block draws; one last block is drawn document by document, so that the words
taken come within one document of the target. The splitting tree then deals the quotas
out to the output shards: each node splits its quota vector between its two halves by a
multivariate-hypergeometric draw, so every shard gets whole blocks, the shards together
draw each block exactly as often as planned, and each shard's composition is that of a
uniform shuffle. Rows are shuffled within their shard by hash.

The driver holds the table of sources and of blocks only. ``max_blocks`` bounds the
blocks whatever the input's size; sources are a configuration and are checked against
``max_sources``. The number of shards follows from the words of all documents, so a shard stays
about as large at any size of input. The text moves once, to its shard, and only when the mixed
rows are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DRAWS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("whole", T.ArrayType(T.IntegerType())),
    T.StructField("part_shard", T.IntegerType()),
    T.StructField("part_words", T.DoubleType()),
    T.StructField("source_size", T.LongType()),
    T.StructField("target", T.DoubleType()),
])


CUTS = "m_source string, m_cuts array<struct<lo:bigint,hi:bigint,most:bigint>>"


@dataclass
class Mixer:
    """Parameters. weights: by position in the sources' order, repeating."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeats: int = 3
    shards: int | None = None  # by default one for each shard_words, and at most max_blocks / 8
    shard_words: int = 1_000_000
    block_words: int = 20_000
    max_blocks: int = 262_144
    max_sources: int = 200_000
    seed: int = 17


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the whole by weight; none above ``cap`` times its size, the excess shared anew."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        if weight <= 0:
            break
        full = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard the sources that it draws from and how many blocks of each: quotas dealt out
    to shards of equal totals, by halves. A node looks at the sources only that it has blocks of."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    some = np.flatnonzero(quota)
    todo = [(some, quota[some], shards)]
    while todo:
        names, own, n = todo.pop()
        if n == 1:
            out.append((names, own))
            continue
        left = n // 2
        total = int(own.sum())
        # Exact for any total; "marginals" draws source by source.
        mine = rng.multivariate_hypergeometric(own, total * left // n, method="marginals") if total else own
        for part, k in ((own - mine, n - left), (mine, left)):
            todo.append((names[part > 0], part[part > 0], k))
    return out


def _draws(blocks: list, m: Mixer, shards: int) -> list[tuple]:
    """The planned draws of every block: shards of whole draws, and of the one partial draw."""
    by: dict[str | None, list] = {}
    for b in blocks:
        by.setdefault(b["source"], []).append(b)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    sizes = [sum(b["words"] for b in by[s]) for s in names]
    goal = targets(sizes, [m.weights[i % len(m.weights)] for i in range(len(names))], m.max_repeats)
    plans, quota = [], []
    for s, size, want in zip(names, sizes, goal, strict=True):
        own = sorted(by[s], key=lambda b: b["block"])  # block numbers are hash values: a random order
        rounds = min(int(want // size), m.max_repeats) if size else 0
        rest = want - rounds * size if size else 0.0
        seq, part = [b["block"] for _ in range(rounds) for b in own], None
        if rounds < m.max_repeats:
            for b in own:
                if rest <= 0:
                    break
                if b["words"] <= rest:
                    seq.append(b["block"])
                    rest -= b["words"]
                else:
                    part = (b["block"], rest)
                    seq.append(b["block"])
                    break
        plans.append((own, seq, part, size, want))
        quota.append(len(seq))
    rng = np.random.Generator(np.random.PCG64(m.seed))
    dealt: list[list[int]] = [[] for _ in quota]
    for shard, (sources, counts) in enumerate(split_tree(np.array(quota, dtype=np.int64), shards, rng)):
        for k, n in zip(sources.tolist(), counts.tolist(), strict=True):
            dealt[k] += [shard] * n
    out = []
    for s, (own, seq, part, size, want), to_shards in zip(names, plans, dealt, strict=True):
        # A shard takes the next run of the source's sequence: disjoint draws.
        whole: dict[int, list[int]] = {}
        last = None
        for i, (block, to) in enumerate(zip(seq, to_shards, strict=True)):
            if part and i == len(seq) - 1:
                last = to
            else:
                whole.setdefault(block, []).append(to)
        for b in own:
            partial = part is not None and part[0] == b["block"]
            out.append((s, b["block"], whole.get(b["block"], []), last if partial else None, float(part[1]) if partial else None, size, float(want)))
    return out


def _cut(part: pd.DataFrame) -> pd.DataFrame:
    """What to draw of a partial block: runs of hash values (lo, hi] and the largest size drawn there.

    Documents are taken in hash order until the next does not fit; then go on with those that fit
    the rest, until none does. Few runs come of it, as the rest shrinks each time."""
    part = part.sort_values("h")
    h, size, left = part["h"].to_numpy(), part["size"].to_numpy(), float(part["part_words"].iloc[0])
    lo, runs = -(2**63), []
    while len(h):
        fits = size <= left
        if not fits.any():
            break
        h, size = h[fits], size[fits]
        # Equal hash values (repeated rows) stand or fall together.
        ends = np.flatnonzero(np.append(h[1:] != h[:-1], True))
        total = np.cumsum(size)[ends]
        n = int(np.searchsorted(total, left, side="right"))
        if n:
            runs.append((lo, int(h[ends[n - 1]]), int(left)))
            left -= float(total[n - 1])
        skip = ends[n] if n < len(ends) else ends[-1]
        lo = int(h[skip])
        h, size = h[skip + 1 :], size[skip + 1 :]
    return pd.DataFrame({"m_source": [part["source"].iloc[0]], "m_cuts": [[{"lo": a, "hi": b, "most": c} for a, b, c in runs]]})


class MixPlan:
    """What the mix takes. ``decide`` adds to any projection of the documents, without a shuffle,
    source_size, target and shards (array<int>: one entry for each time the mix takes the row)."""

    def __init__(self, docs: DataFrame, m: Mixer, id_col: str, text_col: str, source_col: str):
        self.m, self.id, self.text, self.source = m, id_col, text_col, source_col
        spark = docs.sparkSession
        self.sized = sized = common.materialise(
            docs.select(F.col(id_col), F.col(source_col), self.hash().alias("h"), common.n_words(text_col).alias("size")).toDF("doc_id", "source", "h", "size"),
            "mix-sizes")
        stats = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(m.max_sources + 1).collect()
        if len(stats) > m.max_sources:
            raise ValueError(f"over {m.max_sources} sources: raise max_sources or group them")
        words = sum(r["words"] for r in stats)
        per = max(m.block_words, words / m.max_blocks)
        self.shards = m.shards or min(max(1, -(-words // m.shard_words)), m.max_blocks // 8)
        self.counts = F.broadcast(spark.createDataFrame([(r["source"], max(1, round(r["words"] / per))) for r in stats], "m_source string, m_blocks int"))
        blocked = self._blocked(sized, "source", "h")
        table = blocked.groupBy("source", F.col("m_block").alias("block")).agg(F.sum("size").alias("words")).collect()
        # max_blocks rows and one more per source at most.
        self.draws = F.broadcast(spark.createDataFrame(_draws(table, m, self.shards), DRAWS))
        # A source's partial block, one block per source, is drawn document by document.
        part = self._drawn(blocked, "source").filter(F.col("part_shard").isNotNull()).select("source", "h", "size", "part_words")
        self.cuts = F.broadcast(part.groupBy("source").applyInPandas(_cut, CUTS))

    def hash(self) -> Column:
        return F.xxhash64(F.lit(self.m.seed), F.col(self.id), F.col(self.text))

    def _blocked(self, rows: DataFrame, source: str, h: str) -> DataFrame:
        return rows.join(self.counts, F.col(source).eqNullSafe(F.col("m_source"))).withColumn("m_block", F.pmod(F.col(h), F.col("m_blocks")).cast("int")).drop("m_source", "m_blocks")

    def _drawn(self, blocked: DataFrame, source: str) -> DataFrame:
        d = self.draws.withColumnsRenamed({"source": "m_source", "block": "m_number"})
        return blocked.join(d, F.col(source).eqNullSafe(F.col("m_source")) & (F.col("m_block") == F.col("m_number"))).drop("m_source", "m_number")

    def decide(self, rows: DataFrame, source: str, h: str, size: str) -> DataFrame:
        out = self._drawn(self._blocked(rows, source, h), source)
        out = out.join(self.cuts, F.col(source).eqNullSafe(F.col("m_source")), "left").drop("m_source")
        inside = F.exists("m_cuts", lambda c: (F.col(h) > c.lo) & (F.col(h) <= c.hi) & (F.col(size) <= c.most))
        extra = F.when(F.col("part_shard").isNotNull() & inside, F.array("part_shard")).otherwise(F.array().cast("array<int>"))
        return out.withColumn("shards", F.concat("whole", extra)).drop("m_block", "whole", "part_shard", "part_words", "m_cuts")


def plan_mix(docs: DataFrame, m: Mixer | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, h (its hash), size, source_size, target, shards.

    Null text has size 0, null sources form the last source, rows of size 0 are drawn with their
    block, an empty table gives no rows. Rows equal in id and text are drawn together.
    """
    plan = MixPlan(docs, m or Mixer(), id_col, text_col, source_col)
    return plan.decide(plan.sized, "source", "h", "size")


def mix(docs: DataFrame, m: Mixer | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shuffled: bool = True) -> DataFrame:
    """The mixed rows: all columns of ``docs``, plus mix_shard and mix_order, a random place within
    the shard. A document that is taken k times gives k rows. With ``shuffled`` each shard's rows
    come together and in that order (the one shuffle of the text); else they stay where they are."""
    m = m or Mixer()
    plan = MixPlan(docs, m, id_col, text_col, source_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # no clash with the plan's own columns
    rows = docs.select("*", plan.hash(), common.n_words(text_col)).toDF(*names, "m_h", "m_size")
    rows = plan.decide(rows, names[docs.columns.index(source_col)], "m_h", "m_size")
    shard, place = common.fresh(docs, "mix_shard", "mix_order")
    rows = rows.select(*names, "m_h", F.posexplode("shards").alias("m_copy", "m_shard"))
    rows = rows.select(*names, "m_shard", F.xxhash64(F.lit(m.seed + 1), "m_h", "m_copy").alias("m_place")).toDF(*docs.columns, shard, place)
    if shuffled:
        rows = rows.repartition(plan.shards, shard).sortWithinPartitions(shard, place)
    return rows


def op1(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(common.table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "source")


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """Each source's documents, size and target, as the mix plans them."""
    plan = plan_mix(common.table(spark, sf_dir, "documents"))
    return plan.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 2).alias("target"))


# A source is capped while the level of the open ones is above its cap by weight: sources by that ratio, capped ones first.
TARGETS_SQL = r"""
WITH s AS (SELECT source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * size / weight) AS k, sum(size) OVER ()::DOUBLE AS total FROM w),
c AS (SELECT *, 3 * size / weight AS ratio, (total - coalesce(sum(3 * size) OVER b, 0)) / sum(weight) OVER a AS level FROM r
      WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT min_by(level, k) FILTER (level <= ratio) AS level FROM c)
SELECT source, n_docs, size AS source_size, round(least(3.0 * size, coalesce(l.level, 3.0 * size / weight) * weight), 2) AS target FROM c, l
"""
