"""Sharding by rendezvous hashing: a record's key and the shards decide where it goes, and nothing else does.

Every (key, shard) pair has a hash; the shard with the best score wins, the score being weight / -ln(hash as a number
in (0, 1)), so a shard gets its weight's part of the keys. A new shard only takes records of which it is the best, a
removed one only gives its own away, a changed weight moves records from or to that shard alone. A row needs its own key
only: nothing is shuffled to decide, no table of the shards is kept, and a hot key stays together whatever it weighs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Layout:
    """Shards 0 to n - 1 with their weights (positive). The same salt must be kept for a data set's life."""

    weights: tuple[float, ...]
    salt: str = ""

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0:
            raise ValueError("a layout needs shards of positive weight")

    @staticmethod
    def equal(n: int, salt: str = "") -> Layout:
        return Layout((1.0,) * n, salt)

    def grown(self, weight: float = 1.0) -> Layout:
        return replace(self, weights=(*self.weights, weight))


def _score(key: Column, shard: Column, weight: Column, salt: str) -> Column:
    """Of 52 bits of an MD5 digest, which other systems have too."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(salt), key, F.lit(":"), shard.cast("string"))), 1, 13), 16, 10).cast("double")
    return weight / -F.log((bits + 1) / (2.0**52 + 1))


def shard_of(key: Column, layout: Layout) -> Column:
    """The shard of a key (as text; null is a key of its own, the empty text). Of equal scores the first shard wins."""
    shards = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(layout.weights)))
    text = F.coalesce(key.cast("string"), F.lit(""))
    best = F.array_max(F.transform(shards, lambda s: F.struct(_score(text, s.k, s.w, layout.salt).alias("score"), (-s.k).alias("k"))))
    return -best.k


def assign(docs: DataFrame, layout: Layout, *, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """All columns of ``docs`` and ``name``, without a shuffle. Repeated keys share a shard; an empty table stays empty."""
    return docs.withColumn(name, shard_of(F.col(id_col), layout))


def moved(docs: DataFrame, before: Layout, after: Layout, *, id_col: str = "doc_id") -> DataFrame:
    """The rows that change their shard between two layouts, with from_shard and to_shard."""
    a, b = common.fresh(docs, "from_shard", "to_shard")
    return docs.withColumns({a: shard_of(F.col(id_col), before), b: shard_of(F.col(id_col), after)}).filter(F.col(a) != F.col(b))


def write(docs: DataFrame, folder: str, layout: Layout, *, id_col: str = "doc_id", files: int = 8) -> None:
    """One sub-folder for each shard (shard=k), each of ``files`` files, so that no task writes a shard alone."""
    name, slice_ = common.fresh(docs, "shard", "s_file")
    rows = assign(docs, layout, id_col=id_col, name=name).withColumn(slice_, F.pmod(F.xxhash64(*docs.columns) if docs.columns else F.lit(0), F.lit(files)))
    rows.repartition(len(layout.weights) * files, name, slice_).drop(slice_).write.partitionBy(name).parquet(folder)


def slots(docs: DataFrame, layout: Layout, grown: Layout | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and 16 more), text_crc32, shard, grown_shard (under ``grown``, else null) and slot: the
    place in the shard by doc_id (nulls first), checksum and size, from 0 without gaps. Null text has no bytes."""
    text = common.text_of(text_col)
    after = shard_of(F.col(id_col), grown) if grown is not None else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary")), shard_of(F.col(id_col), layout), after).toDF("doc_id", "size", "text_crc32", "shard", "grown_shard")
    return common.placed(common.materialise(rows, "shard-rows"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


SHARDS = Layout.equal(40)


def op13(spark, sf_dir: str) -> DataFrame:
    return slots(common.table(spark, sf_dir, "documents"), SHARDS, SHARDS.grown()).withColumn("law", F.lit("key"))


def _best_sql(n: int) -> str:
    score = "1 / -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497)"
    return f"CAST(list_aggregate(list_transform(range({n}), lambda k: {{'s': {score}, 'k': -k}}), 'max').k * -1 AS INT)"


OP13_SQL = f"""
WITH c AS (SELECT {common.CRC_TABLE_SQL} AS crc_table),
d AS (SELECT doc_id, CAST(16 + strlen(coalesce(text, '')) AS BIGINT) AS size, CAST({common.crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32, 'key' AS law, {_best_sql(40)} AS shard, {_best_sql(41)} AS grown_shard FROM documents, c)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM d
"""
