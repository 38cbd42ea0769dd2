"""Exact deduplication against immutable snapshots with static binary-fuse filters.

A snapshot holds the groups of equal texts seen so far, dealt into buckets by digest, and one
static fuse filter per bucket (about nine bits a group). A new batch is first grouped by
itself, so a text that a third of the batch shares is one row from there on. The filters
screen the batch's groups; only positives are joined with the snapshot's exact buckets.
Groups of several rows are then checked byte by byte; texts that differ under one digest
are told apart.

Only digests move, save for the byte check, which moves the texts of copied documents alone.
Aggregations are partial before their shuffle and joins on digests are skew joins of AQE.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, fuse

GROUPS = 50_000  # groups in a bucket, on average


@dataclass
class Snapshot:
    """groups: bucket, digest, keep_id, n; filters: bucket, filter; written: the table that holds the groups."""

    groups: DataFrame
    filters: DataFrame
    buckets: int
    written: DataFrame


def digest(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(common.normalised(text_col).cast("binary"), 256))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _group(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("n"))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")


def build_snapshot(rows: DataFrame) -> Snapshot:
    """``rows``: doc_id, digest, n (rows that are equal in both). Written once, never changed."""
    written = common.materialise(_group(rows), "dedup-groups")
    buckets = max(1, -(-written.count() // GROUPS))
    groups = written.withColumn("bucket", _bucket(buckets))

    def make(bucket: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [bucket["bucket"].iloc[0]], "filter": [fuse.build(_keys(bucket["digest"]))]})

    filters = groups.select("bucket", "digest").groupBy("bucket").applyInPandas(make, "bucket int, filter binary")
    return Snapshot(groups, common.materialise(filters, "dedup-filters"), buckets, written)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups of a batch whose digest may be in the snapshot. A batch larger than the snapshot goes to
    several copies of each filter, so a task asks for about ``GROUPS`` digests at most."""

    def ask(new: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(new) or not len(own):
            return new.iloc[:0]
        return new[fuse.contains(own["filter"].iloc[0], _keys(new["digest"]))]

    copies = max(1, -(-groups.count() // (GROUPS * snapshot.buckets)))
    new = groups.withColumns({"bucket": _bucket(snapshot.buckets), "copy": F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(copies)).cast("int")})
    filters = snapshot.filters.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return new.groupBy("bucket", "copy").cogroup(filters.groupBy("bucket", "copy")).applyInPandas(ask, new.schema)


@dataclass
class Decision:
    """rows: doc_id, digest, n (equal rows), keep_id, group_size; dropped, repeated: counts."""

    rows: DataFrame
    dropped: int
    repeated: int


def decide(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", split_id: int | None = None) -> Decision:
    """Group equal texts of ``docs``. Rows of ids under ``split_id`` (their median by default) form the
    snapshot, the others the new batch.

    Null texts count as empty and are equal to each other. Of a group the smallest id stays; null
    ids stay only in a group that has no other. Rows equal in id and text are counted, one stays.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
    rows = common.materialise(texts.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "dedup-digests")
    if split_id is None:
        split_id = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.coalesce(F.col("doc_id") < F.lit(split_id), F.lit(False))
    snapshot = build_snapshot(rows.filter(old))
    new = common.materialise(_group(rows.filter(~old)), "dedup-batch")
    found = screen(new, snapshot).select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    both = common.materialise(found.join(snapshot.groups.select("digest", "keep_id", "n"), "digest"), "dedup-found")
    # Snapshot ids are the smaller ones, but a given split may cut otherwise, or leave null ids.
    both_ids = both.select("digest", F.least("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.col("new_n")).alias("n"))
    alone = snapshot.groups.select("digest", "keep_id", "n").unionByName(new).join(both.select("digest"), "digest", "left_anti")
    groups = common.materialise(alone.unionByName(both_ids), "dedup-sizes")
    decided = rows.join(groups.select("digest", "keep_id", F.col("n").alias("group_size")), "digest")
    several = groups.filter("n > 1").select("digest")
    n_several = several.count()
    if n_several:
        clash = _clashes(docs, id_col, text_col, common.broadcast_if(several, n_several, 100))
        if clash is not None:
            decided = decided.join(clash.select("digest").distinct(), "digest", "left_anti").unionByName(clash)
    decided = common.materialise(decided.select("doc_id", "digest", "n", "keep_id", "group_size"), "dedup-decided")
    common.forget(rows, snapshot.written, snapshot.filters, new, both, groups)
    count = decided.agg(
        F.count_if(~F.col("doc_id").eqNullSafe(F.col("keep_id"))), F.count_if(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") > 1))).first()
    return Decision(decided, count[0], count[1])


def _clashes(docs: DataFrame, id_col: str, text_col: str, several: DataFrame) -> DataFrame | None:
    """Byte check: rows under a digest that stands for different texts, grouped by text; else None."""
    texts = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), common.normalised(text_col).alias("t"))
    spread = texts.join(several, "digest", "left_semi").groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    wrong = common.materialise(spread.filter("a <> b").select("digest"), "dedup-clashes")
    if wrong.isEmpty():
        return None
    rows = texts.join(wrong, "digest", "left_semi").groupBy("doc_id", "digest", "t").agg(F.count("*").alias("n"))
    per = rows.groupBy("t").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return rows.join(per, "t").select("doc_id", "digest", "n", "keep_id", "group_size")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows equal in id and text, any one."""
    d = decide(docs, id_col=id_col, text_col=text_col)
    hid, key = common.fresh(docs, "h_id", "h_digest")
    marks = d.rows.filter((F.col("n") > 1) | ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias(hid), F.col("digest").alias(key), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("h_stays"))
    marks = common.broadcast_if(marks, d.dropped + d.repeated, 120)
    keyed = docs.select("*", F.col(id_col).alias(hid + "_"), digest(text_col).alias(key + "_"))
    same = keyed[hid + "_"].eqNullSafe(marks[hid]) & (keyed[key + "_"] == marks[key])
    out = keyed.join(marks, same, "left_anti").drop(hid + "_", key + "_")
    if d.repeated:
        again = keyed.join(marks.filter("h_stays"), same, "left_semi").dropDuplicates([hid + "_", key + "_"])
        out = out.unionByName(again.drop(hid + "_", key + "_"))
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    rows = decide(common.table(spark, sf_dir, "documents")).rows
    first = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")
    return rows.select("doc_id", "keep_id", "group_size", "digest", first).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
