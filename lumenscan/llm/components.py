"""Connected components of a graph of any size by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, component): each vertex of ``edges`` (u, v; longs) and the smallest vertex that it reaches.

    Edges end as stars around the smallest vertex. Each half step is a minimum by vertex, partial
    before its shuffle, and a join; its result is written out, so nothing is computed twice."""
    # Each edge points from the larger vertex u to the smaller v.
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.materialise(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large.filter("u <> v"), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        spent = edges
        edges = common.materialise(small, "edges")
        common.forget(spent, large)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots.select("v", F.col("v").alias("component")))
