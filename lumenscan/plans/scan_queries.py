"""Queries of the line scanner, entropy, dependencies, triage, fixes and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scratch
from ..functions.text import shannon_entropy
from ..operators import dependencies, entropy, fixes, regex_rules, report, triage
from ..sources import code
from . import full_scan, seeds


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in columns.items()])


def _lines(spark, d, name, key, text) -> DataFrame:
    return regex_rules.lines(table(spark, d, name).select(key, F.col(text).alias("content")))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- SQL of the rules: RE2 has no lookaround, so three rules are put in other words ---------

def rule_sql(rule: regex_rules.Rule, line: str = "line") -> str:
    if rule.id == "SEC_FIREBASE_CONFIG_LEAK":
        return " AND ".join(f"contains(lower({line}), '{w}')" for w in ("apikey", "authdomain", "databaseurl"))
    if rule.id == "INFRA_HARDCODED_HTTP":
        head = r"(?i)https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)"
        return f"regexp_matches(regexp_replace({line}, {_quote(head)}, 'x', 'g'), {_quote(r'(?i)https?://[' + chr(92) + 'w.-]+')})"
    if rule.id == "SEC_HARDCODED_PASSWORD":
        q = "['\"`]"
        head = rf"(?i)password\s*[:=]\s*{q}(\s*{q}|null|undefined)"
        return f"regexp_matches(regexp_replace({line}, {_quote(head)}, ' ', 'g'), {_quote(rf'(?i)password\s*[:=]\s*{q}.+{q}')})"
    return f"regexp_matches({line}, {_quote(rule.pattern)})"


def lines_sql(name: str, key: str, text: str) -> str:
    return f"SELECT {key}, CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM {name}))"


LITERAL_SQL = "|".join(rf"{q}(?:\\{q}|[^{q}\n\r])*{q}" for q in "\"'`").replace("'", "''")


def literals_sql(name: str, key: str, text: str) -> str:
    return f"""SELECT {key}, line_no, CAST(k - 1 AS INT) AS literal_no, substr(m[k], 2, length(m[k]) - 2) AS literal FROM (SELECT {key}, line_no, m, unnest(range(1, len(m) + 1)) AS k
FROM (SELECT {key}, line_no, regexp_extract_all(line, '{LITERAL_SQL}') AS m FROM ({lines_sql(name, key, text)})))"""


ENTROPY_SQL = """list_sum(list_transform(list_distinct(string_split(literal, '')), lambda c: -(length(literal) - length(replace(literal, c, ''))) / length(literal) * log2((length(literal) - length(replace(literal, c, ''))) / length(literal))))"""
BOUNDS_SQL = "length(literal) BETWEEN 16 AND 256 AND NOT contains(literal, ' ')"
PREFIX_SQL = "(starts_with(literal, 'glpat-') OR starts_with(literal, 'ghp_') OR starts_with(literal, 'AKIA'))"
SECRET_SQL = f"""{BOUNDS_SQL} AND ({PREFIX_SQL} OR (regexp_matches(literal, '[a-z]') AND regexp_matches(literal, '[0-9]') AND CASE WHEN {BOUNDS_SQL} THEN {ENTROPY_SQL} ELSE 0 END > CASE WHEN regexp_matches(literal, '[A-Z]') THEN 4.5 ELSE 4.8 END))"""


# -- queries -------------------------------------------------------------------------------

def lines_stats(spark, d):
    x = _lines(spark, d, "documents", "doc_id", "text")
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.length("line") > 2000).alias("n_long"))


def regex_documents(spark, d):
    return regex_rules.scan_lines(_lines(spark, d, "documents", "doc_id", "text")).select("doc_id", "line_no", "rule_id", "level")


def _seeded(spark, d):
    return docs(spark, d, content=seeds.CONTENT)


def regex_all(spark, d):
    return regex_rules.scan_lines(regex_rules.lines(_seeded(spark, d))).select("doc_id", "line_no", "rule_no", "rule_id", "level")


def _one_rule(rule):
    return lambda spark, d: regex_rules.scan_lines(regex_rules.lines(_seeded(spark, d)), (rule,)).select("doc_id", "line_no", "rule_id", "level")


SEEDED_SQL = lines_sql(f"(SELECT doc_id, {seeds.CONTENT} AS t FROM documents)", "doc_id", "t")
REGEX_ALL_SQL = " UNION ALL ".join(f"SELECT doc_id, line_no, {k} AS rule_no, '{r.id}' AS rule_id, '{r.level}' AS level FROM s WHERE {rule_sql(r)}" for k, r in enumerate(regex_rules.RULES))


def string_literals(spark, d):
    x = entropy.literals(_lines(spark, d, "pages", "page_id", "html"))
    return x.select("page_id", "line_no", "literal_no", "literal")


def entropy_values(spark, d):
    x = entropy.literals(_lines(spark, d, "pages", "page_id", "html")).filter(entropy.in_bounds(F.col("literal")))
    return x.select("page_id", "line_no", "literal_no", F.round(shannon_entropy(F.col("literal")), 6).alias("entropy"))


QUOTED = f"concat(coalesce(text, ''), chr(10), 'x = \"', {seeds.TOKEN}, '\"')"  # a whole text and a quoted token


def entropy_secrets(spark, d):
    x = entropy.secrets(regex_rules.lines(docs(spark, d, content=QUOTED)))
    return x.select("doc_id", "line_no", "literal_no", "literal", "rule_id", "level")


def token_flags(spark, d):
    t = F.col("literal")
    return docs(spark, d, literal=seeds.TOKEN).select("doc_id", entropy.in_bounds(t).alias("bounds"), entropy.known_prefix(t).alias("prefix"), entropy.is_secret(t).alias("secret"))


def _packages(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "0 AS ord", f"{seeds.PKG} AS pkg", f"{seeds.VERSION} AS version")


def _advisories(spark):
    return spark.createDataFrame(seeds.ADVISORIES, "pkg string, version string, id string, aliases array<string>, ord int")


def typosquat(spark, d):
    return dependencies.typosquats(_packages(spark, d)).select("p_partkey", "pkg", "version", "meant")


def clean_version(spark, d):
    return _packages(spark, d).select("p_partkey", dependencies.clean_version(F.col("version")).alias("version"))


def advisory_join(spark, d):
    x = dependencies.advisories_of(_packages(spark, d), _advisories(spark))
    return x.select("p_partkey", "pkg", "version", F.array_join("vulnerabilities", ",").alias("vulnerabilities"))


def advisory_ranges(spark, d):
    """Versions with pre-releases and build marks against ranges with open, closed and missing ends."""
    packages = table(spark, d, "part").selectExpr("p_partkey", "0 AS ord", f"{seeds.PKG} AS pkg", f"concat({seeds.RELEASE}, {seeds.TAG}) AS version")
    ranges = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS range_id", f"{seeds.RANGE_PKG} AS pkg", "concat('A', CAST(s_suppkey AS STRING)) AS id", "CAST(NULL AS ARRAY<STRING>) AS aliases", "s_suppkey AS ord", f"{seeds.LOW} AS low", f"{seeds.LOW_OPEN} AS low_open", f"{seeds.HIGH} AS high", f"{seeds.HIGH_OPEN} AS high_open")
    x = dependencies.range_advisories(packages, ranges)
    return x.select("p_partkey", "pkg", "version", F.array_join("vulnerabilities", ",").alias("vulnerabilities"))


def dependency_scan(spark, d):
    x = dependencies.scan(_packages(spark, d), _advisories(spark))
    return x.groupBy("rank", "is_typosquatting").agg(F.count("*").alias("n"), F.count_distinct("pkg").alias("n_pkg"))


def manifest_merge(spark, d):
    return code.manifest_packages(table(spark, d, "part").selectExpr("p_partkey", f"{seeds.MANIFEST} AS package_json")).select("p_partkey", "ord", "pkg", "version")


RULES_OF_PARTS = "SELECT CAST(p_partkey AS STRING) AS id, p_name AS description, CASE p_partkey % 4 WHEN 0 THEN 'SINK' WHEN 1 THEN 'SOURCE' WHEN 2 THEN 'AST_PATTERN' ELSE 'REGEX_MATCH' END AS type, CAST(p_size AS DOUBLE) AS severity, concat(p_brand, '-', p_type) AS target_pattern, p_partkey AS ord FROM part"


def custom_rules_split(spark, d):
    """User rules, here one for each part, by what taint tracking takes of them."""
    rules = spark.sql(RULES_OF_PARTS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    one = lambda kind, name: code.rules_of(rules, kind).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "id", "severity", "description")
    return one("SINK", "function_name").unionByName(one("SOURCE", "source_pattern"))


def fp_triage(spark, d):
    x = docs(spark, d, snippet=seeds.SNIPPET, variable=seeds.VARIABLE)
    return x.withColumn("t", triage.triage(F.col("snippet"), F.col("variable"))).select("doc_id", "t.is_false_positive", "t.confidence")


def poc_template(spark, d):
    x = docs(spark, d, sink=seeds.SINK, path=f"concat('src/', {seeds.FILE})", variable=seeds.VARIABLE)
    return x.withColumn("p", triage.proof(F.col("sink"), F.col("path"), F.col("doc_id").cast("int"), F.col("variable"))).select("doc_id", "p.sink_type", "p.text")


def _fix(f):
    return lambda spark, d: docs(spark, d, line=seeds.FIX_LINE).select("doc_id", f(F.col("line")).alias("fixed"))


def reachability_label(spark, d):
    return docs(spark, d, name=seeds.FILE).select("doc_id", code.is_test_file(F.col("name")).alias("is_test"))


def unified_diff(spark, d):
    x = docs(spark, d, content=f"concat('first', chr(10), {seeds.FIX_LINE}, chr(10), 'last')").withColumn("path", F.lit("a.js")).withColumn("line", F.lit(2))
    return fixes.patches(x, fixes.redos_fix).select("doc_id", "patched", "diff")


#: A file of a document's text and two lines that may be fixed, and what was found where: (line from the end, kind).
FIXABLE = f"concat(coalesce(text, ''), chr(10), {seeds.FIX_LINE}, chr(10), 'db.query(`x ', chr(36), '{{y}}`); cp.exec(z);')"
FOUND_AT = ((1, "COMMAND_INJECTION"), (1, "REDOS"), (1, "SQL_INJECTION"), (0, "SQL_INJECTION"), (0, "COMMAND_INJECTION"), (0, "COMMAND_INJECTION"))


def edit_scripts(spark, d):
    """Several findings in each file, some on one line: one patch for the file."""
    files = docs(spark, d, file_id="CAST(doc_id AS STRING)", content=FIXABLE).withColumn("path", F.lit("a.js"))
    n = F.size(F.split("content", "\n", -1))
    found = files.select("file_id", F.explode(F.array(*(F.struct((n - back).alias("line"), F.lit(kind).alias("kind")) for back, kind in FOUND_AT))).alias("f")).select("file_id", "f.*")
    x = fixes.file_patches(fixes.fixed_lines(found, files, full_scan.fix_by_kind), files)
    return x.select(F.col("file_id").cast("long").alias("doc_id"), F.size("edits").cast("long").alias("n_edits"), "patched", F.size(F.regexp_extract_all("diff", F.lit(r"(?m)^\+(?!\+)"), F.lit(0))).cast("long").alias("n_added"))


def _findings(spark, d):
    x = docs(spark, d, type=seeds.KIND, endpoint=seeds.ENDPOINT, file_id="doc_id % 17")
    return x.withColumn("seq", F.col("doc_id"))


def priority_sort(spark, d):
    x = _findings(spark, d)
    w = Window.partitionBy("file_id").orderBy(report.weight(F.col("type")).desc(), "seq")
    return x.select("file_id", "doc_id", "type", F.row_number().over(w).alias("place"))


def endpoints_distinct(spark, d):
    return _findings(spark, d).groupBy("file_id", "endpoint").agg(F.min("seq").alias("first_seq"))


def totals(spark, d):
    x = _findings(spark, d)
    return x.groupBy("type").agg(F.count("*").alias("n_issues"), F.count_distinct("file_id").alias("n_files"), F.count_distinct("endpoint").alias("n_endpoints"))


def summary_cube(spark, d):
    return regex_all(spark, d).cube("level", "rule_id").agg(F.count("*").alias("n")).withColumns({"level": F.coalesce("level", F.lit("*")), "rule_id": F.coalesce("rule_id", F.lit("*"))})


def sarif_rules(spark, d):
    x = regex_all(spark, d).withColumn("seq", F.struct("doc_id", "line_no", "rule_no"))
    return report.distinct_rules(x).select("rule_id", F.col("first.doc_id").alias("doc_id"), F.col("first.rule_no").alias("rule_no"))


def sarif_results(spark, d):
    """One SARIF document for each of 17 projects, read again."""
    x = regex_rules.scan_lines(regex_rules.lines(_seeded(spark, d)))
    x = x.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("f"), "doc_id", F.lit(".js")).alias("basename"), "line_no", "rule_id", "level", "message", "rule_no")
    none = x.filter("false").withColumn("literal_no", F.lit(0))
    found = report.in_report_order(x, none).withColumn("project", F.col("file_id") % 17)
    schema = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
    out = report.sarif(found, by=("project",)).withColumn("s", F.from_json("sarif", schema)).select("project", F.col("s.runs")[0].alias("run"))
    ids = F.array_join(F.transform("run.tool.driver.rules", lambda r: r.id), ",")
    uris = F.array_join(F.transform("run.results", lambda r: F.concat(r.ruleId, F.lit("@"), r.locations[0].physicalLocation.artifactLocation.uri, F.lit(":"), r.locations[0].physicalLocation.region.startLine.cast("string"))), ",")
    return out.select("project", F.size("run.results").cast("long").alias("n_results"), ids.alias("rules"), uris.alias("results"))


REPORTED = f"concat({seeds.CONTENT}, chr(10), 'x = \"', {seeds.TOKEN}, '\"')"  # lines for the rules and tokens for the entropy check


def sarif_document(spark, d):
    """The report of all documents, both passes, written as one SARIF document of many fragments and read back: its rules with
    their places, and its results."""
    rows = regex_rules.lines(docs(spark, d, content=REPORTED).select(F.col("doc_id").alias("file_id"), F.concat(F.lit("f"), "doc_id", F.lit(".js")).alias("basename"), "content"))
    folder = scratch.new_folder(spark, "sarif")
    report.write_sarif(report.in_report_order(regex_rules.scan_lines(rows), entropy.secrets(rows)), folder)
    shown = spark.read.text(folder, pathGlobFilter="*-results.json").select(F.from_json(F.ltrim(F.col("value"), F.lit(",")), "ruleId string, level string, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>").alias("r"))
    at = F.col("r.locations")[0].physicalLocation
    results = shown.select(F.lit(None).cast("int").alias("place"), F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), at.artifactLocation.uri.alias("uri"), at.region.startLine.alias("line_no"))
    head = spark.read.text(folder, pathGlobFilter="*-head.json", wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit('"id": "([^"]+)"'), F.lit(1))).alias("place", "rule_id"))
    return results.unionByName(head.select("place", "rule_id", *(F.lit(None).cast(t).alias(c) for c, t in (("level", "string"), ("uri", "string"), ("line_no", "int")))))


QUERIES = {
    "lines_stats": lines_stats, "regex_documents": regex_documents, "regex_all": regex_all,
    **{f"regex_{r.id.lower()}": _one_rule(r) for r in regex_rules.RULES},
    "string_literals": string_literals, "entropy_values": entropy_values, "entropy_secrets": entropy_secrets, "token_flags": token_flags,
    "typosquat": typosquat, "clean_version": clean_version, "advisory_join": advisory_join, "advisory_ranges": advisory_ranges, "dependency_scan": dependency_scan, "manifest_merge": manifest_merge,
    "custom_rules_split": custom_rules_split, "fp_triage": fp_triage, "poc_template": poc_template,
    "fix_redos": _fix(fixes.redos_fix), "fix_command": _fix(fixes.command_fix), "fix_sql": _fix(fixes.sql_fix), "unified_diff": unified_diff, "edit_scripts": edit_scripts,
    "reachability_label": reachability_label, "priority_sort": priority_sort, "endpoints_distinct": endpoints_distinct, "totals": totals,
    "summary_cube": summary_cube, "sarif_rules": sarif_rules, "sarif_results": sarif_results, "sarif_document": sarif_document,
}

_S = f"WITH s AS (SELECT * FROM ({SEEDED_SQL}) WHERE length(line) <= 2000) "
_P = f"WITH p AS (SELECT p_partkey, 0 AS ord, {seeds.PKG} AS pkg, {seeds.VERSION} AS version FROM part), t(pkg, meant) AS {seeds.values(list(dependencies.LOOK_ALIKES.items()))}, a(pkg, version, id, aliases, ord) AS {seeds.values(seeds.ADVISORIES)} "
_CLEAN = r"regexp_replace(version, '[\^~>]', '', 'g')"
_ADV = f"""SELECT p_partkey, p.pkg, {_CLEAN.replace('version', 'p.version')} AS version, string_agg(coalesce(id, aliases[1], 'Unknown CVE'), ',' ORDER BY a.ord) AS vulnerabilities
FROM p JOIN a ON a.pkg = p.pkg AND a.version = {_CLEAN.replace('version', 'p.version')} WHERE p.pkg NOT IN (SELECT pkg FROM t) GROUP BY ALL"""
_W = "CASE type WHEN 'security' THEN 5 WHEN 'auth' THEN 4 WHEN 'endpoint' THEN 3 WHEN 'performance' THEN 2 WHEN 'quality' THEN 1 ELSE 0 END"
_F = f"WITH f AS (SELECT doc_id, {seeds.KIND} AS type, {seeds.ENDPOINT} AS endpoint, doc_id % 17 AS file_id FROM documents) "
_FIX = f"WITH x AS (SELECT doc_id, {seeds.FIX_LINE} AS line FROM documents) SELECT doc_id, "
_PROOFS = " ".join(f"WHEN '{k}' THEN replace({_quote(v[1])}, '%v', variable)" for k, v in triage.PROOFS.items())

_FIXED = {
    "REDOS": f"CASE WHEN contains(line, '(.*)*') OR contains(line, '(a*)*') THEN concat(replace(replace(line, '(.*)*', '(.*){{1,10}}'), '(a*)*', 'a*'), '{fixes.NOTE}') END",
    "COMMAND": f"""CASE WHEN NOT contains(line, 'exec(') THEN line ELSE concat(CASE WHEN regexp_matches(line, '\\.exec\\(.*?\\)') THEN regexp_replace(line, '\\.exec\\((.*?)\\)', '.execFile(''sh'', [''-c'', \\1])')
ELSE regexp_replace(line, 'exec\\((.*?)\\)', 'execFile(''sh'', [''-c'', \\1])') END, '{fixes.NOTE}') END""",
    "SQL": "NULL",  # the command fix comes first and always gives a line
}

ORACLE_SQL = {
    "lines_stats": f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(line) > 2000) AS n_long FROM ({lines_sql('documents', 'doc_id', 'text')}) GROUP BY doc_id",
    "regex_documents": f"WITH s AS (SELECT * FROM ({lines_sql('documents', 'doc_id', 'text')}) WHERE length(line) <= 2000) SELECT doc_id, line_no, rule_id, level FROM ({REGEX_ALL_SQL})",
    "regex_all": _S + REGEX_ALL_SQL,
    **{f"regex_{r.id.lower()}": _S + f"SELECT doc_id, line_no, '{r.id}' AS rule_id, '{r.level}' AS level FROM s WHERE {rule_sql(r)}" for r in regex_rules.RULES},
    "string_literals": literals_sql("pages", "page_id", "html"),
    "entropy_values": f"SELECT page_id, line_no, literal_no, round({ENTROPY_SQL}, 6) AS entropy FROM ({literals_sql('pages', 'page_id', 'html')}) WHERE {BOUNDS_SQL}",
    "entropy_secrets": f"SELECT doc_id, line_no, literal_no, literal, 'HIGH_ENTROPY_SECRET' AS rule_id, 'error' AS level FROM ({literals_sql(f'(SELECT doc_id, {QUOTED} AS t FROM documents)', 'doc_id', 't')}) WHERE {SECRET_SQL}",
    "token_flags": f"SELECT doc_id, {BOUNDS_SQL} AS bounds, {PREFIX_SQL} AS prefix, {SECRET_SQL} AS secret FROM (SELECT doc_id, {seeds.TOKEN} AS literal FROM documents)",
    "typosquat": _P + "SELECT p_partkey, pkg, version, meant FROM p JOIN t USING (pkg)",
    "clean_version": _P + f"SELECT p_partkey, {_CLEAN} AS version FROM p",
    "advisory_join": _P + _ADV,
    "advisory_ranges": _P + f"""SELECT p_partkey, p.pkg, p.version, string_agg(r.id, ',' ORDER BY r.ord) AS vulnerabilities
FROM (SELECT p_partkey, {seeds.PKG} AS pkg, concat({seeds.RELEASE}, {seeds.TAG}) AS version, {seeds.order_sql(f"concat({seeds.RELEASE}, {seeds.TAG})")} AS k FROM part) p
JOIN (SELECT s_suppkey AS ord, concat('A', s_suppkey) AS id, {seeds.RANGE_PKG} AS pkg, {seeds.order_sql(seeds.LOW)} AS lo, {seeds.LOW_OPEN} AS lo_open, {seeds.order_sql(seeds.HIGH)} AS hi, {seeds.HIGH_OPEN} AS hi_open FROM supplier) r
ON r.pkg = p.pkg AND (lo IS NULL OR k > lo OR (k = lo AND NOT lo_open)) AND (hi IS NULL OR k < hi OR (k = hi AND NOT hi_open))
WHERE p.pkg NOT IN (SELECT pkg FROM t) GROUP BY ALL""",
    "dependency_scan": _P + f"SELECT 0 AS rank, true AS is_typosquatting, count(*) AS n, count(DISTINCT pkg) AS n_pkg FROM p JOIN t USING (pkg) UNION ALL SELECT 1, false, count(*), count(DISTINCT pkg) FROM ({_ADV})",
    "manifest_merge": f"""WITH p AS (SELECT p_partkey, {seeds.PKG} AS pkg, {seeds.VERSION} AS version FROM part) SELECT p_partkey, 0 AS ord, pkg, version FROM p
UNION ALL SELECT p_partkey, 1, 'shared', concat('~2.0.', p_partkey % 10) FROM p UNION ALL SELECT p_partkey, 2, concat('dev-', p_partkey % 4), '>1.0.0' FROM p""",
    "custom_rules_split": f"SELECT type AS kind, target_pattern AS name, id, severity, description FROM ({RULES_OF_PARTS}) WHERE type IN ('SINK', 'SOURCE')",
    "fp_triage": f"""WITH x AS (SELECT doc_id, lower({seeds.SNIPPET}) AS s, lower({seeds.VARIABLE}) AS v FROM documents), y AS (SELECT doc_id, v = 'key' AND (contains(s, 'react') OR contains(s, 'map(') OR contains(s, 'classname')) AS k,
(contains(v, 'api') OR contains(v, 'secret')) AND contains(s, 'header') AS h FROM x) SELECT doc_id, k AS is_false_positive, CAST(CASE WHEN k THEN 0.95 WHEN h THEN 0.99 ELSE 0.5 END AS DOUBLE) AS confidence FROM y""",
    "poc_template": f"WITH x AS (SELECT doc_id, {seeds.SINK} AS sink_type, {seeds.VARIABLE} AS variable, {seeds.FILE} AS name FROM documents) SELECT doc_id, sink_type, CASE sink_type {_PROOFS} ELSE concat('Inspect the flow to ''', variable, ''' in ', name, ' at line ', doc_id) END AS text FROM x",
    "fix_redos": _FIX + f"CASE WHEN contains(line, '(.*)*') OR contains(line, '(a*)*') THEN concat(replace(replace(line, '(.*)*', '(.*){{1,10}}'), '(a*)*', 'a*'), '{fixes.NOTE}') END AS fixed FROM x",
    "fix_command": _FIX + f"""CASE WHEN NOT contains(line, 'exec(') THEN line ELSE concat(CASE WHEN regexp_matches(line, '\\.exec\\(.*?\\)') THEN regexp_replace(line, '\\.exec\\((.*?)\\)', '.execFile(''sh'', [''-c'', \\1])')
ELSE regexp_replace(line, 'exec\\((.*?)\\)', 'execFile(''sh'', [''-c'', \\1])') END, '{fixes.NOTE}') END AS fixed FROM x""",
    "fix_sql": _FIX + f"CASE WHEN contains(line, 'query(') AND contains(line, '${{') THEN concat(regexp_replace(line, '`([^`]*?)\\$\\{{([^}}]+)\\}}([^`]*?)`', '''\\1 ? \\3'', [\\2]'), '{fixes.NOTE}') END AS fixed FROM x",
    "reachability_label": f"SELECT doc_id, regexp_matches(lower({seeds.FILE}), '\\.test\\.|\\.spec\\.|test|mock') AS is_test FROM documents",
    "priority_sort": _F + f"SELECT file_id, doc_id, type, row_number() OVER (PARTITION BY file_id ORDER BY {_W} DESC, doc_id) AS place FROM f",
    "endpoints_distinct": _F + "SELECT file_id, endpoint, min(doc_id) AS first_seq FROM f GROUP BY ALL",
    "totals": _F + "SELECT type, count(*) AS n_issues, count(DISTINCT file_id) AS n_files, count(DISTINCT endpoint) AS n_endpoints FROM f GROUP BY type",
    "summary_cube": _S + f"SELECT coalesce(level, '*') AS level, coalesce(rule_id, '*') AS rule_id, count(*) AS n FROM ({REGEX_ALL_SQL}) GROUP BY CUBE (level, rule_id)",
    "sarif_rules": _S + f"SELECT rule_id, min(doc_id) AS doc_id, min(rule_no) AS rule_no FROM ({REGEX_ALL_SQL}) GROUP BY rule_id",
    "sarif_results": _S + f""", r AS ({REGEX_ALL_SQL}), u AS (SELECT doc_id % 17 AS project, rule_id, min((doc_id, line_no, rule_no)) AS first FROM r GROUP BY ALL)
SELECT project, n_results, rules, results FROM (SELECT doc_id % 17 AS project, count(*) AS n_results, string_agg(concat(rule_id, '@f', doc_id, '.js:', line_no), ',' ORDER BY doc_id, line_no, rule_no) AS results FROM r GROUP BY 1)
JOIN (SELECT project, string_agg(rule_id, ',' ORDER BY first) AS rules FROM u GROUP BY 1) USING (project)""",
    "sarif_document": f"""WITH s AS (SELECT * FROM ({lines_sql(f"(SELECT doc_id, {REPORTED} AS t FROM documents)", "doc_id", "t")}) WHERE length(line) <= 2000),
r AS ({REGEX_ALL_SQL}), e AS (SELECT doc_id, line_no FROM ({literals_sql(f"(SELECT doc_id, {REPORTED} AS t FROM documents)", "doc_id", "t")}) WHERE {SECRET_SQL}),
f AS (SELECT 0 AS pass, doc_id, line_no, rule_no AS n, rule_id, level FROM r UNION ALL SELECT 1, doc_id, line_no, 0, 'HIGH_ENTROPY_SECRET', 'error' FROM e)
SELECT NULL::INT AS place, rule_id, level, concat('f', doc_id, '.js') AS uri, line_no FROM f
UNION ALL SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INT), rule_id, NULL, NULL, NULL FROM (SELECT rule_id, min((pass, doc_id, line_no, n)) AS first FROM f GROUP BY rule_id)""",
    "edit_scripts": f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS head, {seeds.FIX_LINE} AS line, concat('db.query(`x ', chr(36), '{{y}}`); cp.exec(z);') AS last FROM documents),
y AS (SELECT *, coalesce({_FIXED["COMMAND"]}, {_FIXED["REDOS"]}, {_FIXED["SQL"]}) AS one FROM x)
SELECT doc_id, 2 AS n_edits, concat(head, chr(10), one, chr(10), 'db.query(`x ', chr(36), '{{y}}`); cp.execFile(''sh'', [''-c'', z]);{fixes.NOTE}') AS patched, CASE WHEN one = line THEN 1 ELSE 2 END AS n_added FROM y""",
}
