"""Checks of the classic pass over token tables: security, authentication, performance, quality, endpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scratch
from ..functions.text import at_most
from . import tokens as tk

# Names, patterns and limits of the checks.
URL_LIKE = r"(?i)^(http://|https://|/api/|/v[1-9]+/)"
JWT = r"^eyJ(?:[a-zA-Z0-9_-]{2,})\.eyJ(?:[a-zA-Z0-9_-]{2,})\.[a-zA-Z0-9_-]{10,}\z"
AWS_KEY, GITHUB_KEY = r"AKIA[0-9A-Z]{16}", r"ghp_[a-zA-Z0-9]{36}"
STATIC_SECRET = r"^[a-zA-Z0-9_-]{20,}\z"
BRANCHES = ("if", "for", "while", "case", "default", "catch")
SENSITIVE = ("password", "token", "secret")
MINIFIED_LINES, MINIFIED_CHARS, AES_KEY_CHARS, MAX_NESTING = 10, 1000, 32, 4


@dataclass
class Parsed:
    """A scan's token tables: written out once by ``prepare``, so every check reads the columns that it needs."""

    files: DataFrame
    tokens: DataFrame
    items: DataFrame
    calls: DataFrame
    folder: str
    cut: DataFrame  # all tokens, with bounds of placeholders and errors, and the lines on which they begin
    inner: DataFrame  # the names that parentheses and templates amount to
    statements: DataFrame | None = None
    assignments: DataFrame | None = None

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        """A table that several checks read, or one that ends a long plan, beside the token tables."""
        return scratch.write(rows, f"{self.folder}/{name}")

    def release(self) -> None:
        """Deletes the written tables, once all results are written."""
        scratch.delete(self.files.sparkSession, self.folder)


def prepare(files: DataFrame) -> Parsed:
    """``files``: file_id, content. The token table feeds every check; it is dealt out by file once."""
    folder = scratch.new_folder(files.sparkSession, "tokens")
    cut = scratch.write(tk.lexed(files), f"{folder}/cut")
    t = scratch.write(tk.tokens(cut), f"{folder}/tokens")
    inner = scratch.write(tk.inner_names(cut), f"{folder}/inner")
    items = scratch.write(tk.children(t, inner), f"{folder}/items")
    return Parsed(files, t, items, scratch.write(tk.arguments(tk.calls(t), items), f"{folder}/calls"), folder, cut, inner)


def _finding(rows: DataFrame, kind: str, rule: str, message, *, order: int = 0, start: str = "start") -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    return rows.select("file_id", F.lit(kind).alias("type"), F.lit(rule).alias("rule_id"), text.alias("message"), F.col("line").cast("int").alias("line_no"), F.struct(F.col(start).cast("int").alias("pos"), F.lit(order).alias("rule")).alias("seq"))


def _hit(when: Column, kind: str, rule: str, message, *, order: int = 0) -> Column:
    """What ``_finding`` gives of a row, where ``when`` holds, else null."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule_id"), text.alias("message"), F.lit(order).alias("rule")))


def _findings(rows: DataFrame, hits: Column, *, start: str = "start") -> DataFrame:
    """The findings of many rules that judge the same rows: an array of ``_hit``. The rows are made once, not once a rule."""
    each = rows.select("file_id", "line", F.col(start).cast("int").alias("pos"), F.explode(F.array_compact(hits)).alias("hit"))
    return each.select("file_id", "hit.type", "hit.rule_id", "hit.message", F.col("line").cast("int").alias("line_no"), F.struct("pos", "hit.rule").alias("seq"))


def taint_sources(p: Parsed) -> DataFrame:
    """Names that take their value from a request, a location or local storage, with the place: file_id, var, pos."""
    t = p.tokens
    req = (F.col("text") == "req") & (F.col("next1") == ".") & F.col("next2").isin("query", "body")
    storage = (F.col("text") == "localStorage") & (F.col("next1") == ".") & (F.col("next2") == "getItem")
    location = (F.col("kind") == "name") & (F.col("next1") == ".") & (F.col("next2") == "location")
    first = t.filter((F.col("prev1") == "=") & (F.col("prev2_kind") == "name") & (req | storage | location))
    return first.select("file_id", F.col("prev2").alias("var"), F.col("pos").alias("source_pos"))


def tainted_calls(p: Parsed, calls: DataFrame) -> DataFrame:
    """``calls`` with tainted: whether the first argument is, or a template holds, a name tainted before it."""
    a = F.get("args", F.lit(0))
    names = F.concat(tk.alone(a, "name"), tk.alone(a, "template"))
    first = taint_sources(p).groupBy("file_id", "var").agg(F.min("source_pos").alias("source_pos"))
    hit = calls.select("file_id", "open", F.explode(names).alias("var")).join(first, ["file_id", "var"]).filter("source_pos < open").select("file_id", "open").distinct().withColumn("tainted", F.lit(True))
    return calls.join(hit, ["file_id", "open"], "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))


def literals(p: Parsed) -> DataFrame:
    """Values of strings and chunks of templates: file_id, pos, line, value. Directives are no values."""
    directive = F.col("prev1").isNull() | F.col("prev1").isin("{", ";")
    string = (F.col("kind") == "string") & ~(directive & F.coalesce(F.col("next1") == ";", F.lit(False)))
    values = F.when(string, F.array(tk.string_value(F.col("text")))).when(F.col("kind") == "template", F.col("chunks"))
    return p.tokens.filter("kind IN ('string', 'template')").select("file_id", "pos", "line", F.explode(values).alias("value"))


def complexity(p: Parsed) -> DataFrame:
    """Branches of each file: statements that branch, cases, catches, conditional and logical operators."""
    t = p.tokens
    word = (F.col("kind") == "name") & F.col("text").isin(*BRANCHES) & ~F.coalesce(F.col("prev1").isin(".", "?."), F.lit(False)) & ~((F.col("text") == "default") & (F.coalesce(F.col("prev1") == "export", F.lit(False)) | (F.col("next1") != ":")))
    keyed = word & F.coalesce(F.col("next1") == ":", F.lit(False)) & ~F.col("text").isin("case", "default")
    ask = (F.col("kind") == "mark") & F.col("text").isin("?", "&&", "||", "??")
    # "catch" of a promise is a member and "while" of a do statement counts once, with its "do".
    return p.files.select("file_id").join(t.filter((word & ~keyed) | ask).groupBy("file_id").agg(F.count("*").cast("int").alias("complexity")), "file_id", "left").fillna(0, ["complexity"])


def whole_file(p: Parsed) -> DataFrame:
    f = p.files.withColumns({"line": F.lit(1), "start": F.lit(-1)})
    few = (F.size(F.split("content", "\n", -1)) < MINIFIED_LINES) & ~at_most(F.col("content"), MINIFIED_CHARS)
    mapped = F.col("content").contains("//# sourceMappingURL=")
    return _findings(f, F.array(_hit(mapped, "security", "SOURCE_MAP", "Source map address in the file"), _hit(few, "quality", "MINIFIED", "Minified file, checks may miss", order=1)))


def _options(p: Parsed, calls: DataFrame, place: Column) -> DataFrame:
    """Properties of an object argument: file_id, open, key, value (text of a value of one token)."""
    a = F.get("args", place)
    holds = calls.filter(F.coalesce(F.get(a, F.lit(0)).text == "{", F.lit(False))).select("file_id", F.col("open").alias("call"), F.get(a, F.lit(0)).pos.alias("open"))
    k = F.col("toks")
    return holds.join(p.items, ["file_id", "open"]).filter(F.get(k, F.lit(0)).kind == "name").select("file_id", F.col("call").alias("open"), F.get(k, F.lit(0)).text.alias("key"), F.when((F.size(k) == 3) & (F.get(k, F.lit(1)).text == ":"), F.get(k, F.lit(2)).text).alias("value"))


def call_rules(p: Parsed) -> DataFrame:
    """Every call is read once: it meets the tainted names and its options, and then all rules judge it."""
    calls = p.calls.filter(~F.col("is_new") & ~F.col("optional"))
    arg = [F.get("args", F.lit(k)) for k in range(3)]
    value = [tk.string_value(F.get(a, F.lit(0)).text) for a in arg]
    name, member, n = F.col("name"), F.col("member"), F.size("args")
    request, cookie = member & (name == "request"), member & (name == "cookie")
    is_true = F.coalesce(F.col("value") == "true", F.lit(False))
    options = _options(p, calls.filter(request | (cookie & (n == 3))), F.when(name == "request", 0).otherwise(2)).groupBy("file_id", "open").agg(
        F.count_if((F.col("key") == "rejectUnauthorized") & (F.col("value") == "false")).cast("int").alias("unchecked"), (F.bool_or((F.col("key") == "secure") & is_true) & F.bool_or((F.col("key") == "httpOnly") & is_true) & F.bool_or(F.lower("key") == "samesite")).alias("safe"))
    c = tainted_calls(p, calls).join(options, ["file_id", "open"], "left")
    plain, cipher = ~member, member & (name == "createCipheriv") & (n >= 3)
    decoded = F.coalesce((F.get(arg[0], F.lit(0)).text == "atob") & (F.get(arg[0], F.lit(1)).text == "("), F.lit(False))
    cors = member & name.isin("setHeader", "header") & (n == 2) & tk.one(arg[0], "string") & tk.one(arg[1], "string") & (F.lower(value[0]) == "access-control-allow-origin") & (value[1] == "*")
    net = ((plain & name.isin("fetch", "axios")) | (member & (F.col("object") == "axios"))) & tk.one(arg[0], "string")
    loose = cookie & (n == 3) & F.coalesce(F.get(arg[2], F.lit(0)).text == "{", F.lit(False)) & ~F.coalesce("safe", F.lit(False))
    hits = F.array(
        _hit(plain & (name == "eval"), "security", "EVAL", F.when(F.col("tainted"), "Request data reaches eval").otherwise("eval runs text as code"), order=3),
        _hit(member & (name == "exec") & (F.col("tainted") | F.coalesce(F.col("object") == "child_process", F.lit(False))), "security", "EXEC", F.when(F.col("tainted"), "Request data reaches a process call").otherwise("Process call with a command line"), order=5),
        _hit(net, "endpoint", "NETWORK_CALL", F.concat(F.lit("Endpoint "), value[0]), order=6),
        _hit(plain & name.isin("md5", "sha1"), "security", "WEAK_HASH", F.concat(F.lit("Weak hash "), name), order=8),
        _hit(cipher & tk.one(arg[1], "string") & at_most(value[1], AES_KEY_CHARS - 1), "security", "SHORT_KEY", "Cipher key under 256 bits", order=9),
        _hit(cipher & tk.one(arg[2], "string"), "security", "STATIC_IV", "Fixed initialisation vector", order=10),
        _hit(member & name.isin("publicEncrypt", "privateDecrypt"), "security", "RSA_PADDING", "Default RSA padding", order=10),
        _hit(member & (F.col("object") == "Math") & (name == "random"), "security", "WEAK_RANDOM", "Math.random is no secure source", order=11),
        _hit(plain & (name == "eval") & decoded, "security", "HIDDEN_CODE", "eval of decoded text", order=12),
        _hit(member & name.endswith("Sync"), "performance", "SYNC_IO", F.concat(F.lit("Blocking call "), name), order=13),
        _hit(member & (F.col("object") == "Object") & (name == "assign"), "security", "OBJECT_ASSIGN", "Object.assign may pollute prototypes", order=15),
        _hit(member & name.isin("exists", "existsSync", "access", "accessSync"), "security", "CHECK_THEN_USE", F.concat(F.lit("File checked before use by "), name), order=17),
        _hit(cors, "security", "CORS_ANY", "CORS open to every origin", order=18),
        _hit(loose, "security", "COOKIE_FLAGS", "Cookie without secure, httpOnly or sameSite", order=20),
        _hit(cookie & (n < 3), "security", "COOKIE_FLAGS", "Cookie without options", order=20),
    )
    # One finding for each such property.
    tls = F.array_repeat(_hit(request, "security", "TLS_OFF", "Certificates are not checked", order=19), F.coalesce("unchecked", F.lit(0)))
    return _findings(c, F.concat(hits, tls))


def token_rules(p: Parsed) -> DataFrame:
    t = p.tokens.withColumn("start", F.col("pos"))
    lit = literals(p).withColumn("start", F.col("pos"))
    v = F.col("value")
    token = v.rlike(JWT) | v.rlike(AWS_KEY) | v.rlike(GITHUB_KEY)
    label = F.when(v.rlike(JWT), "JWT").when(v.rlike(AWS_KEY), "AWS").otherwise("GitHub")
    sensitive = lambda c: F.lower(c).rlike("|".join(SENSITIVE))
    near = ((F.col("prev1_kind") == "name") & sensitive("prev1") & ~F.coalesce(F.col("prev2").isin(".", "?."), F.lit(False))) | ((F.col("next1_kind") == "name") & sensitive("next1") & ~F.coalesce(F.col("next2").isin(".", "(", "[", "?."), F.lit(False)))
    # The first of two values may be the left of a longer expression; only bare names and literals count.
    compare = t.filter((F.col("kind") == "mark") & near)
    literal = F.coalesce(F.col("prev1_kind") == "string", F.lit(False)) | F.coalesce(F.col("next1_kind") == "string", F.lit(False))
    html = t.filter((F.col("text") == "innerHTML") & (F.col("prev1") == ".") & F.col("next1").isin("=", "+="))
    first = taint_sources(p).groupBy("file_id", F.col("var").alias("next2")).agg(F.min("source_pos").alias("source_pos"))
    bare = F.coalesce(F.col("next3").isin(";", ")", "}", ","), F.lit(True)) | F.col("next3").rlike("^[A-Za-z_$]")
    html = html.join(first, ["file_id", "next2"], "left").withColumn("tainted", F.coalesce((F.col("source_pos") < F.col("pos")) & bare, F.lit(False)))
    empty = t.filter((F.col("text") == "catch") & ~F.coalesce(F.col("prev1") == ".", F.lit(False))).join(t.select("file_id", F.col("pos").alias("next1_close"), F.col("next1").alias("a1"), F.col("next2").alias("a2")), ["file_id", "next1_close"], "left")
    empty = empty.filter(((F.col("a1") == "{") & (F.col("a2") == "}")) | ((F.col("next1") == "{") & (F.col("next2") == "}")))
    spread = t.filter((F.col("text") == "...") & F.col("prev1").isin("{", ",")).select("file_id", F.col("parent").alias("pos")).distinct()
    spread = t.filter((F.col("text") == "{") & F.coalesce(F.col("prev1").isin("=", "(", ",", ":", "[", "return", "=>", "?", "&&", "||"), F.lit(False))).join(spread, ["file_id", "pos"])
    out = [
        _findings(lit, F.array(
            _hit(v.rlike(URL_LIKE), "endpoint", "URL_LITERAL", F.concat(F.lit("Route or address "), v), order=7),
            _hit(token, "auth", "TOKEN_LITERAL", F.concat(F.lit("Token in source text: "), label), order=8),
            _hit(~token & ~at_most(v, 20) & v.rlike(STATIC_SECRET) & F.lower(v).rlike("secret|token"), "auth", "STATIC_SECRET", "Possible static secret", order=8))),
        _findings(compare, F.array(
            _hit(F.col("text") == "==", "auth", "WEAK_EQUALITY", "Weak equality on a credential", order=14),
            _hit((F.col("text") == "===") & literal, "auth", "LITERAL_COMPARE", "Credential compared with a literal", order=14))),
        _finding(html, "security", "INNER_HTML", F.when(F.col("tainted"), "Request data set as markup").otherwise("Markup set from a value"), order=4),
        _finding(empty, "quality", "EMPTY_CATCH", "Errors are swallowed", order=21),
        _finding(spread, "security", "OBJECT_SPREAD", "Object spread may pollute prototypes", order=16),
    ]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


# Words that may stand beside another word or value.
BESIDE = tuple(
    "let const var function class return typeof new in of instanceof async await get set static yield import export from as default case else do throw delete void extends if for while switch try catch finally break "
    "continue with debugger type interface implements private public protected readonly declare enum namespace module abstract keyof is infer satisfies override accessor unique asserts global require".split())
NEED_RIGHT = tuple("+ - / % ^ = += -= *= /= %= &= |= ^= ||= &&= ??= == === != !== <= >= && || ?? => .".split())
NEED_LEFT = tuple("% ^ = += -= *= %= == === != !== <= >= && || ?? => .".split())


def misplaced(p: Parsed) -> DataFrame:
    """Tokens where no statement can be read on: file_id, pos. A sign without what it needs to its right or left, a
    comma at the front of a call, two values in a row on one line. Files with elements of markup are not judged, nor are signs
    that types and generators use in other ways."""
    t = p.tokens.filter("kind <> 'template'")
    mark = F.col("kind") == "mark"
    has = lambda c, *texts: F.coalesce(F.col(c).isin(*texts), F.lit(False))
    value = lambda c: F.coalesce(F.col(c).isin("name", "number", "string"), F.lit(False))
    right = mark & F.col("text").isin(*NEED_RIGHT) & (has("next1", ")", "]", "}", ";", ",") | F.col("next1").isNull()) & ~has("next1_kind", "string")
    left = mark & F.col("text").isin(*NEED_LEFT) & (has("prev1", "(", "[", ";", ",", "const", "let", "var", "return", "=", "+=", "-=", "&&", "||", "??", "==", "!=", "===", "!==", "=>") & ~has("prev2", ".", "?.") & ~((F.col("text") == ".") & has("next1_kind", "number")) & ~((F.col("text") == "=>") & has("prev1", ")")))
    comma = mark & (F.col("text") == ",") & has("prev1", "(", "=")
    beside = value("kind") & value("prev1_kind") & (F.col("prev1_line") == F.col("line")) & ~F.col("text").isin(*BESIDE) & ~has("prev1", *BESIDE) & ~has("prev2", "@", "#")
    marked = t.filter(((F.col("text") == "<") & has("next1", "/")) | ((F.col("text") == "/") & has("next1", ">"))).select("file_id").distinct()
    return t.filter(right | left | comma | beside).select("file_id", "pos").join(marked, "file_id", "left_anti")


def errors(p: Parsed) -> DataFrame:
    """Files that cannot be read whole: file_id, error. Missing content, texts without an end, brackets that do not meet,
    signs and values where none can stand."""
    own = F.max(F.when(F.col("text") == "text", "A text or comment has no end"))
    found = p.cut.filter("kind = 'error'").groupBy("file_id").agg(F.coalesce(own, F.lit("Brackets do not meet")).alias("found"))
    odd = misplaced(p).select("file_id", F.lit("A statement cannot be read").alias("odd")).distinct()
    rows = p.files.select(F.col("file_id").cast("string"), F.col("content").isNull().alias("missing")).join(found, "file_id", "left").join(odd, "file_id", "left")
    return rows.select("file_id", F.when(F.col("missing"), "No content").otherwise(F.coalesce("found", "odd")).alias("error")).filter("error IS NOT NULL")


def deep_nesting(p: Parsed) -> DataFrame:
    """Blocks with more than MAX_NESTING enclosing blocks of branches and loops, themselves included.

    A block is of a branch or loop if it follows its parenthesis, or else or do. Depth is a running count over
    opening and closing braces of such blocks, so no join of blocks with their ancestors is needed."""
    t = p.tokens
    braces = t.filter(F.col("text").isin("{", "}") & (F.col("kind") == "mark"))
    heads = t.filter((F.col("text") == "(") & F.coalesce(F.col("prev1").isin("if", "for", "while", "await"), F.lit(False))).select("file_id", (F.col("close") + 1).alias("pos"), F.lit(True).alias("ruled"))
    b = braces.filter("text = '{'").join(heads, ["file_id", "pos"], "left").withColumn("ruled", F.coalesce("ruled", F.lit(False)) | F.coalesce(F.col("prev1").isin("else", "do"), F.lit(False)))
    # Statement blocks also follow ")", "=>", try, finally, or a statement's end; others are objects.
    b = b.withColumn("block", F.col("ruled") | F.coalesce(F.col("prev1").isin(")", "=>", "try", "finally", ";", "{", "}"), F.lit(True)))
    step = lambda when, pos, d, judged: F.when(when, F.struct(F.col(pos).alias("pos"), F.lit(d).alias("d"), F.lit(judged).alias("judged")))
    steps = b.select("file_id", "line", F.explode(F.array_compact(F.array(step(F.col("ruled"), "pos", 1, 0), step(F.col("ruled"), "close", -1, 0), step(F.col("block"), "pos", 0, 1)))).alias("s")).select("file_id", "line", "s.*")
    run = steps.withColumn("n", F.sum("d").over(Window.partitionBy("file_id").orderBy("pos", "judged").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _finding(run.filter((F.col("judged") == 1) & (F.col("n") > MAX_NESTING)), "quality", "DEEP_NESTING", F.concat(F.lit("Nesting of depth "), F.col("n").cast("string")), order=15, start="pos")


def scan(p: Parsed) -> DataFrame:
    """All findings: file_id, type, rule_id, message, line_no, seq (sorts as they stand in the file)."""
    return whole_file(p).unionByName(call_rules(p)).unionByName(token_rules(p)).unionByName(deep_nesting(p))


def endpoints(p: Parsed) -> DataFrame:
    """file_id, endpoint, seq of every address that a call or literal names."""
    a = F.get("args", F.lit(0))
    net = p.calls.filter(((~F.col("member") & F.col("name").isin("fetch", "axios")) | (F.col("member") & (F.col("object") == "axios"))) & tk.one(a, "string") & ~F.col("is_new") & ~F.col("optional"))
    return net.select("file_id", tk.string_value(F.get(a, F.lit(0)).text).alias("endpoint"), F.col("start").cast("int").alias("seq")).unionByName(
        literals(p).filter(F.col("value").rlike(URL_LIKE)).select("file_id", F.col("value").alias("endpoint"), F.col("pos").cast("int").alias("seq")))
