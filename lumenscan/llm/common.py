"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scratch

#: White space of the contracts: space and the five ASCII controls from tab on.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """In the folder that driver and executors share."""
    return scratch.new_folder(spark, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor never costs more than one step."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    out = scratch.write(df, path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple] = {}


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialise`` wrote, once all that is made of them is written too."""
    for t in tables:
        own, path = _written.pop(id(t), (lambda: None, None))
        if own() is t:
            scratch.delete(t.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a worker holds few long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Like ``small_batches`` for the jobs that run within; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Gives the memory that a Python worker has freed back to the machine: a worker that idles stands beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def trimmed(run: Callable) -> Callable:
    """``run``, a function of batches or of a group, with ``trim`` behind it."""
    @wraps(run)
    def of_batches(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return of_batches


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` as a broadcast side where its counted rows are surely small; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def normalised(column: str = "text") -> Column:
    """The text with each run of white space as one space, null as empty."""
    return F.regexp_replace(text_of(column), WHITE, " ")


def placed(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: each row's place in its group by ``order`` (nulls first), from 0 without gaps.

    Rows are sorted by range, so a large group lies in many partitions, one after the other; what a partition
    holds of a group is a run of the order, and only the runs' lengths are summed up. Rows equal in all these
    columns are told apart by where they stood, so a group of equal rows is no hot spot either. ``rows`` should be
    a written table, as the ranges are sampled from it."""
    seq, part, at, n = fresh(rows, "p_seq", "p_part", "p_at", "p_n")
    keys = [F.col(c) for c in (*groups, *order)] + [F.col(seq)]
    spread = rows.withColumn(seq, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialise(spread.withColumn(seq, F.monotonically_increasing_id()), "placed").withColumn(part, F.shiftright(seq, 33))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy(*groups, part).agg(F.min(seq).alias(at), F.count("*").alias(n)).select(*groups, part, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(at)).alias(at))
    runs = runs.toDF(*(f"{at}_{k}" for k in range(len(groups))), f"{at}_part", at)
    same = F.col(part) == F.col(f"{at}_part")
    for k, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"{at}_{k}"))
    return ranged.join(runs, same).select(*rows.columns, (F.col(seq) + F.col(at)).alias(name))


#: DuckDB has no CRC-32: its table as a list, and the checksum of a text's bytes by it.
CRC_TABLE_SQL = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"


def crc_sql(text: str, table: str = "crc_table") -> str:
    taken = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({taken}, lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295)"
