"""Source code as a table of tokens, with brackets, calls and arguments, by windows and joins.

A small lexer cuts each file into tokens and matches its brackets, templates within placeholders of templates included. All
else is made of the table: neighbours by a window, the names that parentheses and placeholders amount to by running sums
over nested intervals, calls with their arguments by joins. Files are dealt out; a file is at most one window partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexer

# Words of the language that take a parenthesis but are no call.
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "typeof", "function", "new", "throw", "await", "else", "do", "case", "in", "of", "delete", "void", "super", "with", "yield", "async")
ASSIGNS = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "||=", "&&=", "??=")
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = lexer.SCHEMA + ", source string"
_FIELDS = pa.schema([("file_id", pa.string()), *((n, _TYPES[k]) for n, k in (c.split() for c in _SCHEMA.split(", ")))])
#: What arrays of tokens hold of each.
TOKEN = ("pos", "kind", "text", "close", "role", "gives", "core", "alone", "sole", "inner")


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one text at a time
            text = content.as_py()
            found = lexer.lex(text)
            lines, told = text.split("\n") if found else [], 0
            for k in range(0, len(found), 50_000):
                part, source = found[k : k + 50_000], []
                for t in part:
                    source.append(lines[t.line - 1] if t.line > told else None)
                    told = max(told, t.line)
                columns = [pa.array([getattr(t, f.name) for t in part], f.type) for f in list(_FIELDS)[1:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(part), pa.string()), *columns, pa.array(source, pa.string())], schema=_FIELDS)


def lexed(files: DataFrame) -> DataFrame:
    """file_id, the fields of ``lexer.Token`` and source, for every token of ``files`` (file_id, content). source: the line as it
    stands in the file, with the first token that begins on it."""
    return files.select(F.col("file_id").cast("string"), F.col("content").cast("string")).mapInArrow(_lexed, "file_id string, " + _SCHEMA)


def lines(cut: DataFrame) -> DataFrame:
    """file_id, line, text of every line on which a token begins."""
    return cut.filter("source IS NOT NULL").select("file_id", "line", F.col("source").alias("text"))


def tokens(cut: DataFrame) -> DataFrame:
    """Tokens without bounds of placeholders and errors, with the neighbours' texts and kinds: those of the same stretch of
    code, as a template is one token of the code around it."""
    order = Window.partitionBy("file_id", "region").orderBy("pos")
    near = {}
    for k in (1, 2, 3):
        near |= {f"prev{k}": F.lag("text", k).over(order), f"next{k}": F.lead("text", k).over(order)}
    near |= {"prev1_kind": F.lag("kind", 1).over(order), "prev2_kind": F.lag("kind", 2).over(order), "next1_kind": F.lead("kind", 1).over(order), "next1_close": F.lead("close", 1).over(order), "prev1_line": F.lag("line", 1).over(order)}
    return cut.drop("source").filter(~F.col("kind").isin("hole", "error")).withColumns(near)


def inner_names(cut: DataFrame) -> DataFrame:
    """file_id, pos, inner: the names that the value of outermost parentheses, or of a template, comes from, in order.

    Parentheses and placeholders pass on what their expression comes from, at any depth, unless something between gives
    nothing, such as a call's arguments, a negation or a choice. What gives nothing is an interval of places; a name counts
    where none is open."""
    carried = cut.filter("top IS NOT NULL OR spoilt").select("file_id", F.coalesce("top", "pos").alias("top"), "pos", "kind", "text", "close", "gives", "spoilt", F.col("top").isNotNull().alias("nested"))
    shut = carried.filter("close IS NOT NULL AND (spoilt OR (nested AND NOT gives AND kind <> 'hole'))")
    steps = shut.select("file_id", "top", "pos", F.lit(None).cast("string").alias("name"), F.lit(1).alias("d")).unionByName(shut.select("file_id", "top", F.col("close").alias("pos"), F.lit(None).cast("string").alias("name"), F.lit(-1).alias("d")))
    names = carried.filter("nested AND gives AND kind = 'name'").select("file_id", "top", "pos", F.col("text").alias("name"), F.lit(0).alias("d"))
    running = Window.partitionBy("file_id", "top").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = names.unionByName(steps).withColumn("shut", F.sum("d").over(running)).filter("name IS NOT NULL AND shut = 0")
    return free.groupBy("file_id", F.col("top").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("inner"))


def calls(t: DataFrame) -> DataFrame:
    """Calls: file_id, open (pos of the parenthesis), name, member, object (name before the dot, if one), is_new,
    optional, line, start (pos where the callee's last part begins), close. A name alone in brackets, ``o[name](...)``, is a
    member's, one in parentheses, ``(name)(...)``, is as good as bare."""
    c = t.filter((F.col("kind") == "name") & (F.col("next1") == "(") & ~F.col("text").isin(*KEYWORDS) & ~F.coalesce(F.col("prev1").isin("function"), F.lit(False)))
    member = F.coalesce(F.col("prev1") == ".", F.lit(False))
    opening = t.filter("text = '(' AND kind = 'mark'").select("file_id", F.col("pos").alias("open"), F.col("role").alias("open_role"), F.col("close"))
    columns = ["file_id", "open", "name", "member", "optional", "object", "is_new", "line", "start"]
    plain = c.select(
        "file_id", (F.col("pos") + 1).alias("open"), F.col("text").alias("name"), member.alias("member"), F.coalesce(F.col("prev1") == "?.", F.lit(False)).alias("optional"),
        F.when(member & (F.col("prev2_kind") == "name") & ~F.coalesce(F.col("prev3").isin(".", "?."), F.lit(False)), F.col("prev2")).alias("object"), F.coalesce(F.when(member, F.col("prev3")).otherwise(F.col("prev1")) == "new", F.lit(False)).alias("is_new"),
        "line", (F.col("pos") - F.when(member, 2).otherwise(0)).alias("start"))
    held = t.filter(F.col("role").isin("index", "group") & (F.col("kind") == "mark") & (F.col("next1_kind") == "name") & F.col("next2").isin("]", ")") & (F.col("next3") == "(") & F.col("text").isin("[", "("))
    index = F.col("text") == "["
    held = held.select(
        "file_id", (F.col("pos") + 3).alias("open"), F.col("next1").alias("name"), index.alias("member"), (index & F.coalesce(F.col("prev1") == "?.", F.lit(False))).alias("optional"),
        F.when(index & (F.col("prev1_kind") == "name") & ~F.coalesce(F.col("prev2").isin(".", "?."), F.lit(False)), F.col("prev1")).alias("object"), F.coalesce(F.when(index, F.col("prev2")).otherwise(F.col("prev1")) == "new", F.lit(False)).alias("is_new"),
        "line", (F.col("pos") - F.when(index, 1).otherwise(0)).alias("start"))
    # "name(...) {" declares a method.
    return plain.select(columns).unionByName(held.select(columns)).join(opening, ["file_id", "open"], "left").filter(~F.coalesce(F.col("open_role").isin("params", "head"), F.lit(False))).drop("open_role")


def string_value(text: Column) -> Column:
    return text.substr(F.lit(2), F.length(text) - 2)


def token_struct(*more: str) -> Column:
    return F.struct(*TOKEN, *more)


def children(t: DataFrame, inner: DataFrame) -> DataFrame:
    """Items between commas of every bracket: file_id, open, item (from 0), toks: the tokens that stand in it
    directly (TOKEN)."""
    comma = (F.col("text") == ",") & (F.col("kind") == "mark")
    order = Window.partitionBy("file_id", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = t.filter(F.col("parent").isNotNull()).join(inner, ["file_id", "pos"], "left").withColumn("item", F.sum(comma.cast("int")).over(order)).filter(~comma)
    return inside.groupBy("file_id", F.col("parent").alias("open"), "item").agg(F.array_sort(F.collect_list(token_struct())).alias("toks"))


def arguments(c: DataFrame, items: DataFrame) -> DataFrame:
    """Calls with their arguments: adds args, an array by place of arrays of tokens."""
    per = items.groupBy("file_id", "open").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "toks"))), lambda x: x.toks).alias("args"))
    # A trailing comma leaves no item behind it; a closing bracket is no item's token, as it stands outside.
    return c.join(per, ["file_id", "open"], "left").withColumn("args", F.coalesce("args", F.array().cast(per.schema["args"].dataType)))


def one(arg: Column, kind: str) -> Column:
    """Whether an argument is a single token of a kind (false where it is missing)."""
    return F.coalesce((F.size(arg) == 1) & (F.get(arg, F.lit(0)).kind == kind), F.lit(False))


def alone(arg: Column, kind: str) -> Column:
    """The names of an argument that is a single token of a kind, in any number of parentheses; else none."""
    first = F.get(arg, F.lit(0))
    single = (F.size(arg) == 1) | ((F.size(arg) == 2) & (first.role == "group"))
    return F.when(single & (first.alone == kind), F.coalesce(first.sole, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def names_of(arg: Column) -> Column:
    """Names that an expression takes its value from: bases of member chains, operands of arithmetic and comparisons, names in
    templates and parentheses, callees. Logical and conditional expressions, assignments, operands of words and signs such as
    ``!`` and ``new``, literals, arrays, objects and functions give none."""
    none = F.exists(arg, lambda x: (x.kind == "mark") & x.text.isin(*lexer.BLOCKERS))
    parts = F.transform(F.filter(arg, lambda x: x.gives), lambda x: F.when(x.kind == "name", F.array(x.text)).otherwise(F.coalesce(x.inner, F.array().cast("array<string>"))))
    return F.when(none | (F.size(arg) == 0), F.array().cast("array<string>")).otherwise(F.flatten(parts))
