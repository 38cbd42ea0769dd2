"""Suggested one-line fixes.

``command_fix`` still hands its input to a shell, so it mitigates nothing; it is there for parity.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE = " // [patched]"


def redos_fix(line: Column) -> Column:
    """Nested quantifiers bounded; null where there is none."""
    fixed = F.replace(F.replace(line, F.lit("(.*)*"), F.lit("(.*){1,10}")), F.lit("(a*)*"), F.lit("a*"))
    return F.when(fixed != line, F.concat(fixed, F.lit(NOTE)))


def _first(line: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced: a lazy prefix from the start keeps later ones as they are."""
    return F.regexp_replace(line, rf"(?s)^(.*?){pattern}", "$1" + replacement)


def command_fix(line: Column) -> Column:
    """exec turned into execFile with an argument list; other lines as they are."""
    member = _first(line, r"\.exec\((.*?)\)", ".execFile('sh', ['-c', $2])")
    bare = _first(line, r"exec\((.*?)\)", "execFile('sh', ['-c', $2])")
    fixed = F.when(member.contains("execFile"), member).otherwise(bare)
    return F.when(line.contains("exec("), F.concat(fixed, F.lit(NOTE))).otherwise(line)


def sql_fix(line: Column) -> Column:
    """The first placeholder of the first template bound as a parameter; null unless the line is a query with one."""
    fixed = _first(line, r"`([^`]*?)\$\{([^}]+)\}([^`]*?)`", "'$2 ? $4', [$3]")
    return F.when(line.contains("query(") & line.contains("${"), F.concat(fixed, F.lit(NOTE)))


def _unified(path: str, old: str, new: str) -> str:
    lines = difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"{path}\tOriginal", f"{path}\tPatched")
    return "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines)


def _diff(paths: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else _unified(p, o, n) for p, o, n in zip(paths, old, new, strict=True)], dtype=object)


def fixed_lines(found: DataFrame, files: DataFrame, fix) -> DataFrame:
    """``found`` (file_id, line, kind) with patched: the line as ``fix`` (of the line and the kind) leaves it; null where nothing is to
    fix, the line or the content is missing, or kind is null. A file's content meets its findings once, whatever their number."""
    asked = found.filter("line IS NOT NULL AND kind IS NOT NULL").groupBy("file_id").agg(F.collect_set(F.struct(F.col("line").cast("int").alias("line"), "kind")).alias("asked"))
    lines = F.split("content", "\n", -1)
    each = asked.join(files.select("file_id", "content"), "file_id").select("file_id", F.explode(F.transform("asked", lambda a: F.struct(a.line.alias("line"), a.kind.alias("kind"), F.get(lines, a.line - 1).alias("text")))).alias("a"))
    done = each.select("file_id", F.col("a.line").alias("f_line"), F.col("a.kind").alias("f_kind"), fix(F.col("a.text"), F.col("a.kind")).alias("patched")).filter("patched IS NOT NULL").withColumnRenamed("file_id", "f_file")
    same = (F.col("file_id") == F.col("f_file")) & (F.col("line") == F.col("f_line")) & (F.col("kind") == F.col("f_kind"))
    return found.join(done, same, "left").drop("f_file", "f_line", "f_kind")


def fixed_at(found: DataFrame, lines: DataFrame, fix) -> DataFrame:
    """As ``fixed_lines``, by a table of the lines that can be asked for (file_id, line, text; one row each): contents stay where
    they are."""
    return found.join(lines.select("file_id", "line", F.col("text").alias("f_text")), ["file_id", "line"], "left").withColumn("patched", fix(F.col("f_text"), F.col("kind"))).select(*found.columns, "patched")


def file_patches(fixed: DataFrame, files: DataFrame, *, order: str = "kind") -> DataFrame:
    """One patch a file: file_id, path, edits (line to its replacement), patched (the content with all of them) and diff.
    ``fixed``: file_id, line, patched, as ``fixed_lines`` gives them. Of several fixes of one line the first by ``order`` holds;
    files without any have no row."""
    some = fixed.filter("patched IS NOT NULL").groupBy("file_id", F.col("line").cast("int").alias("line")).agg(F.min(F.struct(F.col(order).alias("o"), "patched")).alias("first"))
    scripts = some.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("line", F.col("first.patched").alias("patched"))))).alias("edits"))
    lines = F.split("content", "\n", -1)
    new = F.array_join(F.transform(lines, lambda x, i: F.coalesce(F.try_element_at(F.col("edits"), i + 1), x)), "\n")
    whole = scripts.join(files.select("file_id", "path", "content"), "file_id").withColumn("patched", new)
    return whole.withColumn("diff", F.pandas_udf(_diff, "string")("path", "content", "patched")).select("file_id", "path", "edits", "patched", "diff")


def patches(found: DataFrame, fix) -> DataFrame:
    """``found``: path, content, line, for single findings that bring their content along. Adds patched: the file with ``fix`` applied to that line, and a diff. Null
    where the content is missing or nothing is to fix."""
    lines = F.split("content", "\n", -1)
    fixed = fix(F.element_at(lines, F.col("line").cast("int")))
    new = F.when(fixed.isNotNull(), F.array_join(F.transform(lines, lambda x, i: F.when(i == F.col("line") - 1, fixed).otherwise(x)), "\n"))
    rows = found.withColumn("patched", F.when(F.size(lines) >= F.col("line"), new))

    return rows.withColumn("diff", F.pandas_udf(_diff, "string")("path", "content", "patched"))
