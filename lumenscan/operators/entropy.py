"""Secrets told by the entropy of quoted strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shannon_entropy, string_literals, unquote, utf16_length

# Bounds of length and entropy, prefixes of known tokens.
SHORTEST, LONGEST = 16, 256
ENTROPY, ENTROPY_WITHOUT_UPPER = 4.5, 4.8
PREFIXES = ("glpat-", "ghp_", "AKIA")


def in_bounds(s: Column) -> Column:
    n = utf16_length(s)
    return (n >= SHORTEST) & (n <= LONGEST) & ~s.contains(" ")


def known_prefix(s: Column) -> Column:
    out = F.lit(False)
    for p in PREFIXES:
        out = out | s.startswith(p)
    return out


def is_secret(s: Column) -> Column:
    """Cheap gates come first; entropy is worked out only for what passes them."""
    lower, digit, upper = s.rlike("[a-z]"), s.rlike("[0-9]"), s.rlike("[A-Z]")
    high = F.when(lower & digit, shannon_entropy(s) > F.when(upper, ENTROPY).otherwise(ENTROPY_WITHOUT_UPPER)).otherwise(False)
    return F.when(~in_bounds(s), False).when(known_prefix(s), True).otherwise(high)


def literals(rows: DataFrame, line: str = "line") -> DataFrame:
    """One row per quoted string: the columns of ``rows`` but the line, literal_no from 0, literal (unquoted)."""
    keep = [c for c in rows.columns if c != line]
    cut = rows.select(*keep, F.posexplode(string_literals(F.col(line))).alias("literal_no", "literal"))
    return cut.withColumn("literal", unquote(F.col("literal")))


def secrets(rows: DataFrame, line: str = "line") -> DataFrame:
    found = literals(rows, line).filter(is_secret(F.col("literal")))
    return found.select(*[c for c in rows.columns if c != line], "literal_no", "literal", F.lit("HIGH_ENTROPY_SECRET").alias("rule_id"), F.lit("error").alias("level"), F.lit("String of high entropy").alias("message"))
