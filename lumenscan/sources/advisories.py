"""Advisories in the Open Source Vulnerability format (JSON), as ranges of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dependencies import version_key

OSV = (
    "id string, aliases array<string>, withdrawn string, affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<map<string,string>>>>,versions:array<string>>>")
RANGES = ["range_id", "pkg", "id", "aliases", "ord", "low", "low_open", "high", "high_open"]
KINDS = ("introduced", "fixed", "last_affected", "limit")


def from_json(rows: DataFrame, content: str = "content", *, ecosystem: str = "npm") -> DataFrame:
    """Ranges (RANGES) of advisories held as JSON texts: each pair of an ``introduced`` event and the next ``fixed``, ``limit``
    (both open) or ``last_affected`` (closed) one, and each single version of a list. ``introduced: 0`` has no low end.
    Texts that are no JSON, withdrawn advisories and other ecosystems give none. ord goes by id."""
    a = rows.select(F.from_json(content, OSV).alias("a")).select("a.*").filter("id IS NOT NULL AND withdrawn IS NULL")
    each = a.withColumn("ord", F.xxhash64("id")).select("id", "aliases", "ord", F.explode("affected").alias("x")).filter(F.col("x.package.ecosystem") == ecosystem)
    each = each.select("id", "aliases", "ord", F.col("x.package.name").alias("pkg"), "x.ranges", "x.versions")
    events = each.select("id", "aliases", "ord", "pkg", F.explode("ranges").alias("r")).filter("r.type IN ('SEMVER', 'ECOSYSTEM')")
    kind = lambda e: F.coalesce(*(F.when(e[k].isNotNull(), F.lit(k)) for k in KINDS))
    value = lambda e: F.coalesce(*(e[k] for k in KINDS))
    listed = F.array_sort(F.transform("r.events", lambda e: F.struct(F.when(value(e) == "0", "").otherwise(F.coalesce(version_key(value(e)), F.lit("?"))).alias("key"), (kind(e) == "introduced").alias("start"), kind(e).alias("kind"), value(e).alias("version"))))
    e = events.withColumn("e", listed)
    starts = F.filter(F.transform("e", lambda x, i: F.struct(x.alias("low"), F.get(F.filter(F.slice("e", i + 2, F.size("e")), lambda y: ~y.start), F.lit(0)).alias("high"), (x.start & ((i == 0) | ~F.coalesce(F.get("e", i - 1).start, F.lit(False)))).alias("first"))), lambda p: p["first"])
    pairs = e.select("id", "aliases", "ord", "pkg", F.explode(starts).alias("p"))
    spans = pairs.select("pkg", "id", "aliases", "ord", F.when(F.col("p.low.version") != "0", F.col("p.low.version")).alias("low"), F.lit(False).alias("low_open"), F.col("p.high.version").alias("high"), F.coalesce(F.col("p.high.kind") != "last_affected", F.lit(False)).alias("high_open"))
    single = each.select("pkg", "id", "aliases", "ord", F.explode("versions").alias("low")).select("pkg", "id", "aliases", "ord", "low", F.lit(False).alias("low_open"), F.col("low").alias("high"), F.lit(False).alias("high_open"))
    return spans.unionByName(single).distinct().withColumn("range_id", F.sha1(F.concat_ws(" ", "pkg", "id", "low", F.col("low_open").cast("string"), F.lit("to"), "high", F.col("high_open").cast("string")))).select(*RANGES)


def osv(spark: SparkSession, folder: str, *, ecosystem: str = "npm") -> DataFrame:
    """The ranges of all advisory files (one JSON text each) below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return from_json(files.withColumnRenamed("value", "content"), ecosystem=ecosystem)
