"""Column functions for source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a line of source text.
LINE_ENDS = "\n\r\u2028\u2029"


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units, which source-code tools count in."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def at_most(s: Column, n: int) -> Column:
    """Whether the UTF-16 length is at most n; long and short strings are told by code points alone."""
    return F.when(F.length(s) > n, F.lit(False)).when(F.length(s) * 2 <= n, F.lit(True)).otherwise(utf16_length(s) <= n)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shannon_entropy(s: Column) -> Column:
    """Bits per symbol: counts are of code points, the length is in UTF-16 units; empty gives 0."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = utf16_length(s)
    kinds = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(kinds, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def _literal(q: str) -> str:
    # Iterative form of "quote, escaped quotes or others, quote": possessive, so that long literals need no stack.
    return rf"{q}(?:[^{q}{LINE_ENDS}]*+(?:(?<=\\){q}[^{q}{LINE_ENDS}]*+)*+{q}|[^{LINE_ENDS}]*{q})"


#: A quoted string of any of the three kinds of quotes.
STRING_LITERAL = "|".join(_literal(q) for q in "\"'`")


def string_literals(line: Column) -> Column:
    """The quoted strings of a line, quotes included, left to right."""
    return F.regexp_extract_all(line, F.lit(STRING_LITERAL), F.lit(0))


def unquote(literal: Column) -> Column:
    return literal.substr(F.lit(2), F.length(literal) - 2)
