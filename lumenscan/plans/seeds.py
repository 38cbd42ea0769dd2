"""Inputs made from the synthetic tables, by expressions that Spark and DuckDB both read."""

from __future__ import annotations

H = "md5(cast(doc_id AS STRING))"

#: One line of code for each rule of the line scanner, in its order.
LINES = (
    f"""concat('k = "AKIA', upper(substr({H}, 1, 16)), '"')""",
    f"concat('x ghp_', {H}, substr({H}, 1, 4))",
    f"concat('sk_live_', substr({H}, 1, 24))",
    f"concat('https://hooks.slack.com/services/T', upper(substr({H}, 1, 8)), '/B', upper(substr({H}, 9, 8)), '/', substr({H}, 1, 24))",
    f"concat('AIza', {H}, substr({H}, 1, 3))",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    f"""concat('token = "', {H}, '"')""",
    f"""concat('Password: "p', substr({H}, 1, 9), '"')""",
    "'cfg = {apiKey: 1, authDomain: 2, databaseURL: 3}'",
    f"concat('mongodb+srv://u:', {H}, '@host/db')",
    f"concat('ssh-rsa AAAA', {H})",
    f"concat('jwt.sign(p, ', chr(39), {H}, chr(39), ')')",
    f"concat('API_KEY=', {H})",
    f"concat('{{{{my_secret_', {H}, '}}}}')",
    f"""concat('process.env.JWT_SECRET_X || "', {H}, '"')""",
    """concat('ip "10.1.', cast(doc_id % 250 AS STRING), '.7" ')""",
    "'url 169.254.169.254/latest'",
    """'x = ["prod", "dev"]'""",
    f"concat('s3://bucket-', {H})",
    f"concat({H}, '.blob.core.windows.net')",
    f"concat('http://', CASE WHEN doc_id % 60 = 50 THEN 'localhost' ELSE {H} END, '.org/p')",
    "'kubernetes.default.svc'",
    "'/var/run/docker.sock'",
    "'/v1/users'",
    "concat('localhost:', cast(8000 + doc_id % 100 AS STRING))",
    "'root@corp.com'",
    "'dns.google/resolve'",
    "'Access-Control-Allow-Origin: *'",
    "'__schema'",
    "concat('C:', chr(92), 'Users', chr(92), 'bob', chr(92), 'x')",
)
#: Every seventh line is too long to be scanned.
LINE = "concat(CASE WHEN doc_id % 7 = 3 THEN repeat('x', 2001) ELSE '' END, CASE doc_id % 30 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(LINES)) + " END)"

#: Every document's whole text with such a line behind it.
CONTENT = f"concat(coalesce(text, ''), chr(10), {LINE})"


def program(code: str) -> str:
    """A file that holds the document's whole text as a comment, and the code on the lines behind it."""
    return f"concat('/* ', replace(coalesce(text, ''), '*/', ' '), ' */', chr(10), {code})"


#: The line on which that code begins.
CODE_LINE = "CAST(2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT)"

TOKEN = f"""CASE doc_id % 8 WHEN 0 THEN concat('glpat-', substr({H}, 1, 12)) WHEN 1 THEN concat('ghp_', substr({H}, 1, 20)) WHEN 2 THEN concat('AKIA', upper(substr({H}, 1, 16)))
WHEN 3 THEN concat('QwErTyUiOpAsDfGhJkLzXcVbNm', substr({H}, 1, 12)) WHEN 4 THEN substr({H}, 1, 15) WHEN 5 THEN repeat({H}, 9) WHEN 6 THEN concat({H}, ' words here') ELSE {H} END"""

PKG = """CASE p_partkey % 9 WHEN 0 THEN 'lo-dash' WHEN 1 THEN 'crossenv' WHEN 2 THEN 'node-fetchs' WHEN 3 THEN 'expresss' WHEN 4 THEN 'electorn' ELSE concat('pkg-', cast(p_partkey % 50 AS STRING)) END"""
VERSION = """concat(CASE p_partkey % 5 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' WHEN 3 THEN '' ELSE '^~>' END, cast(p_size AS STRING), '.', cast(p_partkey % 3 AS STRING), '.0')"""
MANIFEST = f"""concat('{{"dependencies": {{"', {PKG}, '": "', {VERSION}, '", "shared": "^1.0.0"}}, "devDependencies": {{"shared": "~2.0.', cast(p_partkey % 10 AS STRING), '", "dev-', cast(p_partkey % 4 AS STRING), '": ">1.0.0"}}}}')"""

#: Versions with tags, and ranges of versions; ``order_sql`` puts such a version into a list of numbers that sorts as it does.
RELEASE = "concat(cast(p_size % 12 AS STRING), '.', cast(p_partkey % 3 AS STRING), '.', cast(p_partkey % 4 AS STRING))"
_TAGS = ("-alpha.2", "-alpha.10", "-beta", "-beta.1", "-rc.1", "", "+b5")
TAG = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TAGS)) + " ELSE '' END"
RANGE_PKG = "concat('pkg-', cast(s_suppkey % 50 AS STRING))"
LOW = "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat(cast(s_suppkey % 12 AS STRING), '.', cast(s_suppkey % 3 AS STRING), '.0', CASE s_suppkey % 4 WHEN 0 THEN '-alpha.2' WHEN 1 THEN '-beta' ELSE '' END) END"
HIGH = "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat(cast(s_suppkey % 12 + s_suppkey % 3 AS STRING), '.', cast(s_suppkey % 2 AS STRING), '.3', CASE s_suppkey % 6 WHEN 0 THEN '-alpha.10' WHEN 1 THEN '-rc.1' ELSE '' END) END"
LOW_OPEN, HIGH_OPEN = "s_suppkey % 2 = 0", "s_suppkey % 3 = 0"


def order_sql(version: str) -> str:
    tag = "CASE " + " ".join(f"WHEN contains(v, '{t}') THEN {k}" for t, k in (("-alpha.2", 0), ("-alpha.10", 1), ("-beta.1", 3), ("-beta", 2), ("-rc.1", 4))) + " ELSE 5 END"
    return f"(SELECT CASE WHEN v IS NOT NULL THEN [CAST(split_part(v, '.', 1) AS INT), CAST(split_part(v, '.', 2) AS INT), CAST(regexp_extract(split_part(v, '.', 3), '^[0-9]+') AS INT), {tag}] END FROM (SELECT {version} AS v))"


VARIABLE = "CASE doc_id % 5 WHEN 0 THEN 'key' WHEN 1 THEN 'apiToken' WHEN 2 THEN 'clientSecret' WHEN 3 THEN 'Key' ELSE 'value' END"
SNIPPET = "CASE doc_id % 7 WHEN 0 THEN 'items.map(x => x)' WHEN 1 THEN 'React.createElement' WHEN 2 THEN 'req.Header(v)' WHEN 3 THEN '<a className=b>' ELSE 'plain code' END"
FIX_LINE = """replace(CASE doc_id % 9 WHEN 0 THEN concat('new RegExp("(a*)*', cast(doc_id AS STRING), '")') WHEN 1 THEN 'x = /(.*)*b(.*)*/' WHEN 2 THEN 'cp.exec(cmd); cp.exec(b)' WHEN 3 THEN 'exec(userInput)'
WHEN 4 THEN 'spawn(x)' WHEN 5 THEN 'db.query(`SELECT * FROM t WHERE a = #{id} AND b = #{other}`)' WHEN 6 THEN 'db.query("SELECT 1")' WHEN 7 THEN 'run(`a #{b}`)' ELSE 'db.query(`x #{y}`); run(`z #{w}`)' END, '#{', concat(chr(36), '{'))"""  # Spark would substitute a variable there
FILE = "CASE doc_id % 6 WHEN 0 THEN 'a.Test.js' WHEN 1 THEN 'b.spec.ts' WHEN 2 THEN 'contest.js' WHEN 3 THEN 'mockData.js' WHEN 4 THEN 'main.js' ELSE 'app.ts' END"
SINK = "CASE doc_id % 6 WHEN 0 THEN 'XSS' WHEN 1 THEN 'COMMAND_INJECTION' WHEN 2 THEN 'SQL_INJECTION' WHEN 3 THEN 'PROTOTYPE_POLLUTION' WHEN 4 THEN 'SSRF' ELSE 'OPEN_REDIRECT' END"
KIND = "CASE doc_id % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'quality' WHEN 3 THEN 'auth' ELSE 'endpoint' END"
ENDPOINT = "concat('/api/', cast(doc_id % 13 AS STRING))"

#: (pkg, version, id, aliases, ord): offline advisories.
ADVISORIES = [(f"pkg-{k}", f"{s}.{k % 3}.0", None if k % 3 == 1 else f"ADV-{k}-{o}", None if k % 3 != 1 else ([f"CVE-{k}-{o}"] if k % 2 else []), o) for k in range(5, 50) for s in range(1, 51, 4) for o in range(1 + k % 2)]
#: (id, description, type, severity, target_pattern, ord): user rules.
RULES = [("r1", "splunk", "SINK", 9.0, "logToSplunk", 0), ("r2", "header", "SOURCE", 7.0, "x-user", 1), ("r3", "unused", "AST_PATTERN", 5.0, "Foo", 2), ("r4", "unused", "REGEX_MATCH", 5.0, "a+", 3), ("r5", "audit", "SINK", 5.0, "audit", 4)]


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]::VARCHAR[]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
