"""Taint tracking from request data to sinks: within a file, across its functions and across files.

Assignments, sanitisers, calls and probes become one table of events. Their effect depends on
order, and files are independent, so events are folded per file in order of place, after one
shuffle by file: one row holds a file's events. What an argument of a function does there does not depend on
who calls, so each argument that a call from another file can name is folded once, and its calls into further files are
edges from argument to argument. Who reaches whom over any number of files follows by path doubling: round j joins what is
reached in under 2^j steps with edges of exactly 2^j steps, and those edges with themselves.
"""

from __future__ import annotations

import posixpath
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scratch
from . import tokens as tk
from .syntax_rules import Parsed

# Sinks by type.
SINKS = {
    "XSS": ("eval", "send"), "COMMAND_INJECTION": ("exec", "spawn", "fork"), "SQL_INJECTION": ("query", "raw", "execute"),
    "PATH_TRAVERSAL": ("readFile", "writeFile", "join"), "SSTI": ("render",), "INSECURE_DESERIALIZATION": ("unserialize",), "YAML_DESERIALIZATION": ("load",),
    "PROCESS_CONTROL": ("exit", "kill", "chdir"), "VM_ESCAPE": ("runInContext",), "FORMAT_STRING": ("format",), "OPEN_REDIRECT": ("redirect",),
    "SSRF": ("axios", "get", "post", "fetch", "request"),
}
SENSITIVE_NAMES = ("password", "token", "secret", "key", "auth")
STARTS = ("const", "let", "var", "if", "return", "for", "while", "function", "else", "try", "do", "switch", "case", "throw", "import", "export", "class", "break", "continue", "async")

FOUND = "file_id string, rule string, sink_type string, name string, line int, arg_no int, var string, flow array<string>, to_path string, export string"
EFFECT = FOUND + ", fn string, of_arg int"
FINDING = ("file_id", "rule", "sink_type", "name", "line", "arg_no", "var", "flow")


def statements(p: Parsed) -> DataFrame:
    """Tokens that stand directly in one statement, or in one of its parts between commas: file_id, block, toks (TOKEN and line),
    head (the statement's first word, carried over the commas). Made once a scan.

    An automaton over the tokens of each block, by windows: a statement begins behind a semicolon, at a word that starts one,
    behind the header of if, for and so on, behind else and do, an arrow, a case's colon, or a line's end that nothing bridges."""
    if p.statements is not None:
        return p.statements
    w = Window.partitionBy("file_id", "block").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, word, b = F.col("text"), F.col("kind") == "name", F.col("b_text")
    t = p.tokens.join(p.inner, ["file_id", "pos"], "left").withColumn("block", F.coalesce("parent", F.lit(0)))
    # The sibling before, and the last word that a colon may belong to.
    t = t.withColumns({"b_text": F.lag("text").over(w), "b_kind": F.lag("kind").over(w), "b_role": F.lag("role").over(w), "b_line": F.lag("line").over(w), "choice": F.last(F.when(text.isin("case", "default", "?"), text), ignorenulls=True).over(upto)})
    op = lambda c: c.rlike(r"^([-+*/%&|^=<>!?:.,(\[]|\?\.|&&|\|\||=>|===?|!==?|[-+*/%&|^?]+=)$")
    begins = (
        b.isNull() | b.isin(";", "=>") | (text == ";") | (word & text.isin(*STARTS) & ~F.coalesce(b.isin(".", "?."), F.lit(False))) | ((b == "}") & word & ~text.isin("from", "as", "in", "of", "instanceof"))
        | ((b == ")") & F.coalesce(F.col("b_role") == "head", F.lit(False))) | ((F.col("b_kind") == "name") & b.isin("else", "do", "try", "finally")) | ((b == ":") & F.coalesce(F.col("choice").isin("case", "default"), F.lit(False)))
        | ((F.col("line") > F.col("b_line")) & ~op(b) & ~op(text) & (F.col("kind") != "template") & ~text.isin(")", "]", "}", "{")))
    t = t.withColumn("begins", F.coalesce(begins, F.lit(False)))
    comma = text.isin(",") & (F.col("kind") == "mark")
    t = t.withColumns({"n": F.sum((F.col("begins") | comma).cast("int")).over(upto), "head": F.last(F.when(F.col("begins"), text), ignorenulls=True).over(upto)}).filter(~(text.isin(";", ",") & (F.col("kind") == "mark")))
    made = t.groupBy("file_id", "block", "n").agg(F.array_sort(F.collect_list(tk.token_struct("line"))).alias("toks"), F.first("head").alias("head")).select("file_id", "block", "toks", "head")
    p.statements = p.write(made, "statements")
    return p.statements


def assignments(p: Parsed) -> DataFrame:
    """file_id, declared, left (tokens before the sign), right (tokens after), bare (the same without parentheses around all
    of it), pos, line: one for each sign of a statement, of ``a = b = c`` two. Defaults of parameters are no assignments.
    Made once a scan."""
    if p.assignments is not None:
        return p.assignments
    params = p.tokens.filter("role = 'params' AND text = '('").select("file_id", F.col("pos").alias("block"))
    s = statements(p).join(params, ["file_id", "block"], "left_anti").withColumn("signs", F.filter(F.transform("toks", lambda x, i: F.when((x.kind == "mark") & x.text.isin(*tk.ASSIGNS), i)), lambda i: i.isNotNull())).filter("size(signs) > 0")
    s = s.select("file_id", "toks", "head", "signs", F.posexplode("signs").alias("k", "at"))
    worded = F.get("toks", F.lit(0)).text.isin("const", "let", "var")
    declared = (F.col("k") == 0) & F.col("head").isin("const", "let", "var") & (F.get("toks", F.col("at")).text == "=")
    start = F.when(F.col("k") > 0, F.get("signs", F.col("k") - 1) + 1).otherwise(worded.cast("int"))
    right = F.slice("toks", F.col("at") + 2, F.greatest(F.size("toks") - F.col("at") - 1, F.lit(0)))
    a = s.select("file_id", F.coalesce(declared, F.lit(False)).alias("declared"), F.slice("toks", start + 1, F.greatest(F.col("at") - start, F.lit(0))).alias("left"), right.alias("right")).filter("size(left) > 0 AND size(right) > 0")
    a = a.withColumns({"pos": F.get("left", F.lit(0)).pos, "line": F.get("left", F.lit(0)).line})
    first = F.get("right", F.lit(0))
    a = a.withColumn("open", F.when((F.size("right") == 2) & (first.role == "group"), first.core))
    bare = p.items.groupBy("file_id", "open").agg(F.max("item").alias("items"), F.first("toks").alias("bare")).filter("items = 0").drop("items")
    like = F.transform("bare", lambda x: F.struct(*(x[c].alias(c) for c in tk.TOKEN), F.lit(None).cast("int").alias("line")))
    wrapped = a.filter("open IS NOT NULL").join(bare, ["file_id", "open"], "left").withColumn("bare", like).drop("open")
    p.assignments = p.write(a.filter("open IS NULL").withColumn("bare", F.col("right")).drop("open").unionByName(wrapped), "assignments")
    return p.assignments


def _chain(toks: Column) -> Column:
    """Whether the tokens are a name or a member chain."""
    return (F.get(toks, F.lit(0)).kind == "name") & ~F.exists(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), lambda x: ~((x.kind == "name") | x.text.isin(".", "[", "]")))


def _event(rows: DataFrame, op: Column | str, *, name="name", refs=None, stop=None, more=None) -> DataFrame:
    none = F.lit(None)
    return rows.select("file_id", F.col("pos").cast("int").alias("pos"), (F.lit(op) if isinstance(op, str) else op).alias("op"), (F.col(name) if isinstance(name, str) else name).alias("name"), (none if refs is None else refs).cast("array<array<string>>").alias("refs"), F.col("line").cast("int").alias("line"), (none if stop is None else stop).cast("int").alias("stop"), (none if more is None else more).cast("array<string>").alias("more"))


def _case(when: Column, op: str, *, name: Column | str = "name", refs=None, more=None) -> Column:
    """What ``_event`` gives of a row, where ``when`` holds, else null."""
    none = F.lit(None)
    return F.when(when, F.struct(F.lit(op).alias("op"), (F.col(name) if isinstance(name, str) else name).alias("name"), (none if refs is None else refs).cast("array<array<string>>").alias("refs"), (none if more is None else more).cast("array<string>").alias("more")))


def _events(rows: DataFrame, *cases: Column) -> DataFrame:
    """The events of all cases of the same rows, which are made once, not once a case."""
    each = rows.select("file_id", "pos", "line", F.explode(F.array_compact(F.array(*cases))).alias("e")).select("file_id", "pos", "line", "e.*")
    return _event(each, F.col("op"), refs=F.col("refs"), more=F.col("more"))


def functions(p: Parsed) -> DataFrame:
    """Function declarations: file_id, name, params, pos and stop of the body."""
    t = p.tokens
    f = t.filter((F.col("kind") == "name") & (F.col("prev1") == "function") & (F.col("next1") == "(")).select("file_id", F.col("text").alias("name"), (F.col("pos") + 1).alias("open"), F.col("next1_close").alias("end"), "line")
    one = p.items.groupBy("file_id", "open").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "toks"))), lambda x: F.get(x.toks, F.lit(0)).text).alias("params"))
    body = t.filter("text = '{'").select("file_id", F.col("pos").alias("body"), "close")
    return f.join(one, ["file_id", "open"], "left").withColumn("body", F.col("end") + 1).join(body, ["file_id", "body"]).select("file_id", "name", F.coalesce("params", F.array().cast("array<string>")).alias("params"), F.col("body").alias("pos"), F.col("close").alias("stop"), "line")


def imports(p: Parsed) -> DataFrame:
    """Names taken from relative modules: file_id, name, module, export, pos, line."""
    s = statements(p).withColumn("texts", F.transform("toks", lambda x: x.text))
    at = F.get("toks", F.lit(0))
    es = s.filter((F.get("texts", F.lit(0)) == "import") & (F.get(F.reverse("toks"), F.lit(0)).kind == "string")).withColumn("module", tk.string_value(F.get(F.reverse("toks"), F.lit(0)).text))
    r = assignments(p).filter(F.get("right", F.lit(0)).text == "require").withColumn("open", F.get("right", F.lit(1)).pos)
    r = r.join(p.calls.filter("name = 'require'").select("file_id", "open", F.get("args", F.lit(0)).alias("arg")), ["file_id", "open"]).filter(tk.one(F.col("arg"), "string")).withColumn("module", tk.string_value(F.get("arg", F.lit(0)).text))
    whole = es.filter(F.get("toks", F.lit(1)).kind == "name").select("file_id", F.get("texts", F.lit(1)).alias("name"), "module", F.lit("default").alias("export"), at.pos.alias("pos"), at.line.alias("line"))
    whole = whole.unionByName(r.filter((F.size("left") == 1) & (F.get("left", F.lit(0)).kind == "name")).select("file_id", F.get("left", F.lit(0)).text.alias("name"), "module", F.lit("default").alias("export"), "pos", "line"))
    holders = es.select("file_id", "module", F.get(F.filter("toks", lambda x: x.text == "{"), F.lit(0)).pos.alias("open"), at.pos.alias("pos"), at.line.alias("line")).unionByName(r.filter(F.get("left", F.lit(0)).text == "{").select("file_id", "module", F.get("left", F.lit(0)).pos.alias("open"), "pos", "line"))
    parts = holders.join(p.items, ["file_id", "open"]).withColumn("w", F.transform("toks", lambda x: x.text)).filter(F.get("toks", F.lit(0)).kind == "name")
    parts = parts.select("file_id", F.get(F.reverse("w"), F.lit(0)).alias("name"), "module", F.get("w", F.lit(0)).alias("export"), "pos", "line")
    return whole.unionByName(parts).filter(F.col("module").startswith("."))


def probes(p: Parsed) -> DataFrame:
    """Uses that matter only for tainted values, but calls: (rule, refs). ``more`` holds "sensitive" where the name must be."""
    a = assignments(p)
    prop = F.get(F.reverse("left"), F.lit(0)).text
    dotted = (F.size("left") >= 3) & (F.get("left", F.greatest(F.size("left") - 2, F.lit(0))).text == ".")
    right = F.array(tk.names_of(F.col("right")))
    out = _events(
        a, _case(dotted & prop.isin("innerHTML", "outerHTML"), "probe", name=F.lit("DOM_XSS"), refs=right),
        _case(dotted & (F.get("left", F.lit(0)).text == "window") & (F.size("left") == 3), "probe", name=F.lit("WINDOW_LEAK"), refs=right, more=F.array(F.lit("sensitive"))))
    asked = p.items.filter(F.get("toks", F.lit(0)).text.isin("$where", "$regex") & (F.get("toks", F.lit(1)).text == ":")).withColumns({"pos": F.get("toks", F.lit(0)).pos, "line": F.lit(None)})
    return out.unionByName(_event(asked, "probe", name=F.lit("NOSQL_OPERATOR"), refs=F.array(tk.names_of(F.slice("toks", 3, F.greatest(F.size("toks") - 2, F.lit(0)))))))


def called(p: Parsed, sinks: DataFrame) -> DataFrame:
    """The events of calls: cleaning, sinks, other calls, and the probes of ``probes``' kind."""
    named = sinks.groupBy(F.col("function_name").alias("name")).agg(F.min_by("sink_type", "ord").alias("sink"))
    c = p.calls.withColumn("pos", F.col("start")).join(F.broadcast(named), "name", "left")
    name, member, made, n = F.col("name"), F.col("member"), F.col("is_new"), F.size("args")
    cleaned = tk.alone(F.get("args", F.lit(0)), "name")
    of = lambda what: member & (F.col("object") == what)
    refs0 = F.when(n > 0, F.array(tk.names_of(F.get("args", F.lit(0)))))
    every = F.transform("args", tk.names_of)
    encoding = tk.string_value(F.get(F.get("args", F.lit(1)), F.lit(0)).text)
    return _events(
        c, _case(member & (name == "sanitize") & (F.size(cleaned) > 0), "sanitize", name=F.get(cleaned, F.lit(0))),
        _case(~made & F.col("sink").isNotNull(), "sink", refs=every, more=F.array("sink", name)),
        _case(~made & F.col("sink").isNull() & ~member, "call", refs=every),
        _case(of("console"), "probe", name=F.lit("SENSITIVE_LOG"), refs=every, more=F.array(F.lit("sensitive"))),
        _case(of("Buffer") & (name == "from") & (n == 2) & encoding.isin("hex", "base64"), "probe", name=F.lit("BUFFER_DECODE"), refs=refs0),
        _case(of("document") & (name == "write"), "probe", name=F.lit("DOCUMENT_WRITE"), refs=refs0),
        _case(made & (name == "Function"), "probe", name=F.lit("FUNCTION_CONSTRUCTOR"), refs=every))


def events(p: Parsed, sinks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All events of each file. ``sinks``: function_name, sink_type, ord. ``sources``: source_pattern, id, ord."""
    a = assignments(p)
    r = F.col("bare")
    request = F.col("declared") & _chain(r) & (F.get(r, F.lit(0)).text == "req") & (F.get(r, F.lit(1)).text == ".") & F.get(r, F.lit(2)).text.isin("query", "body")
    plain = a.filter((F.size("left") == 1) & (F.get("left", F.lit(0)).kind == "name")).withColumn("name", F.get("left", F.lit(0)).text)
    marked = plain.filter(F.coalesce(request, F.lit(False)))
    rest = plain.filter(~F.coalesce(request, F.lit(False)))
    custom = None
    if sources is not None:
        last = F.when(F.get(F.reverse("bare"), F.lit(0)).text == "]", F.lit(None)).otherwise(F.get(F.reverse("bare"), F.lit(0)).text)
        inner = p.items.select("file_id", F.col("open").alias("b"), F.get("toks", F.lit(0)).text.alias("inner"), F.get("toks", F.lit(0)).kind.alias("inner_kind")).filter("inner_kind = 'string' OR inner_kind = 'name'")
        shown = rest.filter(F.col("declared") & _chain(r)).withColumn("b", F.get(F.reverse(F.filter("bare", lambda x: x.text == "[")), F.lit(0)).pos)
        shown = shown.join(inner, ["file_id", "b"], "left").withColumn("shown", F.coalesce(last, F.when(F.col("inner_kind") == "string", tk.string_value(F.col("inner"))).otherwise(F.col("inner"))))
        hit = shown.join(F.broadcast(sources.select("source_pattern", F.col("id").alias("rule"), "ord")), F.col("shown").contains(F.col("source_pattern")))
        custom = hit.groupBy("file_id", "pos", "name", "line").agg(F.min_by("rule", "ord").alias("rule"))
        rest = rest.join(custom.select("file_id", "pos"), ["file_id", "pos"], "left_anti")
    out = _event(marked, "mark", more=F.array(F.lit("Request data")))
    for x in (
        _event(rest, "copy", refs=F.array(tk.names_of(F.col("right")))),
        called(p, sinks),
        _event(functions(p), "function", stop=F.col("stop"), more=F.col("params")),
        _event(imports(p), "import", more=F.array("module", "export")),
        probes(p),
        *([_event(custom, "mark", more=F.array(F.concat(F.lit("Rule "), "rule")))] if custom is not None else []),
    ):
        out = out.unionByName(x)
    return out


def builtin_sinks(spark) -> DataFrame:
    rows = [(f, kind) for kind, names in SINKS.items() for f in names]
    return spark.createDataFrame([(f, kind, k) for k, (f, kind) in enumerate(rows)], "function_name string, sink_type string, ord int")


def _module_path(path: str | None, module: str) -> str:
    to = posixpath.normpath(posixpath.join(posixpath.dirname(path or ""), module))
    return to if to.endswith((".js", ".ts")) else to + ".js"


class Event(NamedTuple):
    pos: int
    op: str
    name: str | None
    refs: list[list[str]] | None
    line: int | None
    stop: int | None
    more: list[str] | None


class _Fold:
    """The state of one file: names that hold request data, each with its flow and whether it was cleaned."""

    def __init__(self, path: str | None, events: list[dict]):
        self.path, self.base = path or "", posixpath.basename(path or "")
        rows = [Event(**e) for e in events]
        self.imports = {r.name: (r.more[0], r.more[1]) for r in rows if r.op == "import"}
        self.functions: dict[str, list] = {}
        for r in rows:
            if r.op == "function":
                self.functions.setdefault(r.name, []).append((r.pos, r.stop, r.more))
        self.events = [r for r in rows if r.op not in ("import", "function")]
        self.places = [e.pos for e in self.events]
        self.reset()

    def reset(self) -> None:
        self.held: dict[str, list] = {}
        self.out: list[tuple] = []

    def first(self, refs) -> str | None:
        return next((n for n in refs if n in self.held and not self.held[n][1]), None)

    def mark(self, name: str, what: str, before: list[str] = ()) -> None:
        self.held[name] = [[*before, f"{self.base}:{what}"], False]

    def found(self, e, rule, kind, arg, var, to=None, export=None) -> None:
        self.out.append((rule, kind, e.name, e.line, arg, var, list(self.held[var][0]), to, export))

    def walk(self, lo: float, hi: float) -> None:
        """Events from lo to hi in order; a call of the file's own function is gone into before the next one."""
        stack = [(bisect_left(self.places, lo), bisect_right(self.places, hi))]
        while stack:
            i, end = stack.pop()
            while i < end:
                inner = self.step(self.events[i])
                i += 1
                if inner:
                    stack.append((i, end))
                    stack += [(bisect_left(self.places, a), bisect_right(self.places, b)) for a, b in reversed(inner)]
                    break

    def step(self, e) -> list[tuple[int, int]]:
        """The effect of one event; the bodies to go into."""
        inner = []
        if e.op == "mark":
            self.mark(e.name, e.more[0])
        elif e.op == "copy":
            if (v := self.first(e.refs[0])) is not None:
                self.mark(e.name, f"Assigned to {e.name}", self.held[v][0])
        elif e.op == "sanitize":
            if e.name in self.held:
                self.held[e.name][1] = True
        elif e.op == "probe":
            for k, refs in enumerate(e.refs if e.refs is not None else []):
                v = self.first(refs)
                if v is not None and (e.more is None or any(s in v.lower() for s in SENSITIVE_NAMES)):
                    self.found(e, e.name, None, k, v)
        else:
            hits = [(k, v) for k, refs in enumerate(e.refs) if (v := self.first(refs)) is not None]
            if e.op == "sink":
                for k, v in hits:
                    self.found(e, "TAINT", e.more[0], k, v)
            elif hits and e.name in self.imports:
                module, export = self.imports[e.name]
                to = _module_path(self.path, module)
                for k, v in hits:
                    self.found(e, "CROSS", None, k, v, to, export)
            elif hits:
                for start, stop, params in self.functions.get(e.name, []):
                    new = [(params[k], v) for k, v in hits if k < len(params) and params[k] not in self.held]
                    for param, v in new:
                        self.mark(param, f"Passed to {e.name}", self.held[v][0])
                    if new:
                        inner.append((start, stop))
        return inner


def _results(fold: _Fold, **columns) -> list[dict]:
    names = ("rule", "sink_type", "name", "line", "arg_no", "var", "flow", "to_path", "export")
    seen, rows = set(), []
    for r in fold.out:  # a function that is declared after its call is walked twice: one finding
        key = (*r[:6], tuple(r[6]), *r[7:])
        if key not in seen:
            seen.add(key)
            rows.append(dict(zip(names, r, strict=True)) | columns)
    return rows


def _each_file(schema: str, make):
    """A function of Arrow batches for mapInArrow: ``make`` gives the rows of each file."""
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    out = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):  # one file's events at a time
                rows += make(b.slice(i, 1).to_pylist()[0])
                if len(rows) > 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    return run


def _whole(file: dict) -> list[dict]:
    fold = _Fold(file["path"], file["events"])
    fold.walk(float("-inf"), float("inf"))
    return _results(fold, file_id=file["file_id"])


def _held(file: dict) -> list[dict]:
    fold = _Fold(file["path"], file["events"])
    fold.walk(float("-inf"), float("inf"))
    return [{"file_id": file["file_id"], "name": n, "flow": f, "cleaned": c} for n, (f, c) in fold.held.items()]


def _enter(file: dict) -> list[dict]:
    """What each argument of a file's functions does there, if it holds request data."""
    fold, rows = _Fold(file["path"], file["events"]), []
    for t in file["targets"]:
        fold.reset()
        for start, stop, params in fold.functions[t["fn"]]:
            if t["of_arg"] < len(params):
                fold.mark(params[t["of_arg"]], f"Passed to {t['fn']}")
                fold.walk(start, stop)
        rows += _results(fold, file_id=file["file_id"], fn=t["fn"], of_arg=t["of_arg"])
    return rows


def _inputs(p: Parsed, sinks: DataFrame | None, sources: DataFrame | None) -> DataFrame:
    """One row for each file that has any: file_id, path, events in order of place."""
    known = builtin_sinks(p.files.sparkSession)
    if sinks is not None:
        known = known.unionByName(sinks.select("function_name", F.lit("CUSTOM_RULE").alias("sink_type"), (F.col("ord") + 1000).alias("ord")))
    per = events(p, known, sources).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "op", "name", "refs", "line", "stop", "more"))).alias("events"))
    return per.join(p.files.select("file_id", F.col("path") if "path" in p.files.columns else F.lit(None).cast("string").alias("path")), "file_id")


def state(p: Parsed, *, sinks: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The names that hold request data at each file's end: file_id, name, flow, cleaned."""
    schema = "file_id string, name string, flow array<string>, cleaned boolean"
    return _inputs(p, sinks, sources).mapInArrow(_each_file(schema, _held), schema)


def _least(paths: DataFrame, *keys: str) -> DataFrame:
    """Of several ways the shortest, and of these the first in order."""
    return paths.groupBy(*keys).agg(F.min(F.struct("steps", "flow")).alias("way")).select(*keys, "way.steps", "way.flow")


def closure(start: DataFrame, edges: DataFrame, write) -> DataFrame:
    """origin, node, steps, flow: all nodes that ``start`` (origin, node, flow) leads to along ``edges`` (node, next, flow), each with
    its least number of steps (1 for start itself) and the flows of that way, one after the other. For paths of n steps there are
    log2(n) rounds; round j looks up one jump of 2^j steps for each node reached in at most 2^j, so what has been reached is read
    once a round. ``write`` writes a table out under a name. Ends when a round reaches nothing new: cycles end too."""
    reached = write(_least(start.select("origin", "node", F.lit(1).alias("steps"), "flow"), "origin", "node"), "reached/0")
    jumps = write(_least(edges.select("node", "next", F.lit(1).alias("steps"), "flow"), "node", "next"), "jumps/0")
    j = 0
    while not (reached.isEmpty() or jumps.isEmpty()):
        far = reached.withColumnsRenamed({"steps": "s", "flow": "f"}).join(jumps, "node").select("origin", F.col("next").alias("node"), (F.col("s") + F.col("steps")).alias("steps"), F.concat("f", "flow").alias("flow"))
        new = write(_least(far.join(reached.select("origin", "node"), ["origin", "node"], "left_anti"), "origin", "node"), f"new/{j}")
        if new.isEmpty():
            break
        j += 1
        reached = write(reached.unionByName(new), f"reached/{j}")
        on = jumps.select(F.col("node").alias("next"), F.col("next").alias("last"), F.col("steps").alias("s"), F.col("flow").alias("f"))
        twice = jumps.join(on, "next").select("node", F.col("last").alias("next"), (F.col("steps") + F.col("s")).alias("steps"), F.concat("flow", "f").alias("flow"))
        jumps = write(_least(twice, "node", "next"), f"jumps/{j}")
    return reached


def track(p: Parsed, *, sinks: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Findings: rule TAINT (with sink_type) or a probe's name, name of the callee, line, arg_no, var, flow, and
    round: 0 within a file, k after k steps into other files, then with origin_file and origin_line of the first call.
    ``p.files`` needs path for imports. Every call that passes request data on has its own findings; of several ways
    from one call to one argument the shortest is told, of these the first. Every round is written, so lineage does not grow."""
    spark = p.files.sparkSession
    folder = scratch.new_folder(spark, "taint")

    def write(rows: DataFrame, name: str) -> DataFrame:
        return scratch.write(rows, f"{folder}/{name}")

    e = write(_inputs(p, sinks, sources), "events")
    start = write(e.mapInArrow(_each_file(FOUND, _whole), FOUND), "start")
    own = start.filter("rule <> 'CROSS'").select(*FINDING, F.lit(0).alias("round"), F.lit(None).cast("string").alias("origin_file"), F.lit(None).cast("int").alias("origin_line"))
    calls = start.filter("rule = 'CROSS'")
    if calls.isEmpty():
        return own
    functions = e.select("file_id", "path", F.explode(F.filter("events", lambda x: x.op == "function")).alias("f"))
    functions = functions.select(F.col("file_id").alias("to_file"), F.col("path").alias("to_path"), F.col("f.name").alias("fn"), F.size("f.more").alias("n_params"))
    # The arguments that some file's import can name; others are reached within their file only.
    named = e.select("path", F.explode(F.filter("events", lambda x: x.op == "import")).alias("i")).select(F.col("path"), F.col("i.more")[0].alias("module"), F.col("i.more")[1].alias("export"))
    named = named.select(_target(F.col("path"), F.col("module")).alias("to_path"), "export").distinct()
    asked = functions.join(named, "to_path").filter((F.col("fn") == F.col("export")) | (F.col("export") == "default")).filter("n_params > 0").select("to_file", "fn", "n_params").distinct()
    asked = asked.select(F.col("to_file").alias("file_id"), F.explode(F.sequence(F.lit(0), F.col("n_params") - 1)).alias("of_arg"), "fn").distinct()
    asked = asked.groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct("fn", "of_arg"))).alias("targets"))
    effects = write(e.join(asked, "file_id").mapInArrow(_each_file(EFFECT, _enter), EFFECT), "effects")
    node = lambda file: F.concat_ws("\u0000", file, "fn", F.col("of_arg").cast("string"))

    def met(rows: DataFrame) -> DataFrame:
        """Calls (to_path, export, arg_no) with the argument that each names: next."""
        found = rows.withColumnsRenamed({"fn": "own_fn", "of_arg": "own_arg"} if "fn" in rows.columns else {}).join(functions, "to_path").filter((F.col("fn") == F.col("export")) | (F.col("export") == "default")).filter("arg_no < n_params")
        return found.withColumn("next", F.concat_ws("\u0000", "to_file", "fn", F.col("arg_no").cast("string")))

    origin = F.sha1(F.to_json(F.struct("file_id", "line", "name", "arg_no", "var", "flow", "to_path", "export")))
    calls = calls.withColumn("origin", origin)
    first = met(calls).select("origin", F.col("next").alias("node"), "flow")
    onward = effects.filter("rule = 'CROSS'").withColumn("node", node(F.col("file_id")))
    reached = closure(first, met(onward).select("node", "next", "flow"), write)
    ends = effects.filter("rule <> 'CROSS'").withColumn("node", node(F.col("file_id"))).withColumnRenamed("flow", "onward")
    both = reached.join(ends, "node").withColumn("flow", F.concat("flow", "onward")).join(calls.select("origin", F.col("file_id").alias("origin_file"), F.col("line").alias("origin_line")).distinct(), "origin")
    return own.unionByName(write(both.select(*FINDING, F.col("steps").alias("round"), "origin_file", "origin_line"), "found"))


def _target(path: Column, module: Column) -> Column:
    """The path that a relative module's name stands for, as ``_Fold`` makes it."""

    @F.pandas_udf("string")
    def joined(paths: pd.Series, modules: pd.Series) -> pd.Series:
        return pd.Series([_module_path(p, m) for p, m in zip(paths, modules, strict=True)], dtype=object)

    return joined(path, module)


def issues(found: DataFrame, sinks: DataFrame | None = None) -> DataFrame:
    """Issues of the findings that reach a sink: file_id, type, message (with the flow), line, severity, sink_type, name."""
    kind = F.col("sink_type")
    rows = found.filter("rule = 'TAINT'")
    if sinks is not None:
        ids = F.broadcast(sinks.groupBy(F.col("function_name").alias("name")).agg(F.min_by("id", "ord").alias("rule_id")))  # user rules: a configuration
        rows = rows.join(ids, "name", "left")
        kind = F.when(kind == "CUSTOM_RULE", F.concat(kind, F.lit(": "), F.col("rule_id"))).otherwise(kind)
    text = F.concat(F.lit("CRITICAL ["), kind, F.lit("] Data Flow Reached Sink: `"), F.col("name"), F.lit("()`. Flow: "), F.array_join("flow", " -> "))
    return rows.select("file_id", F.lit("security").alias("type"), text.alias("message"), F.coalesce("line", F.lit(1)).alias("line"), F.lit("high").alias("severity"), "sink_type", "name", "var", "round")
