"""Reports over findings: order, totals, SARIF and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scratch

# Weights of finding types, version and schema of the report format.
WEIGHTS = {"security": 5, "auth": 4, "endpoint": 3, "performance": 2, "quality": 1}
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def weight(kind: Column) -> Column:
    out = F.lit(0)
    for k, w in WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def by_priority(findings: DataFrame) -> DataFrame:
    """Heaviest types first, else in order of emission."""
    return findings.orderBy(weight(F.col("type")).desc(), "seq")


def in_report_order(regex: DataFrame, entropy: DataFrame) -> DataFrame:
    """Line findings, then entropy findings, with seq: an array that sorts as the report does.
    Both: file_id, basename, line_no, rule_id, level, message, and rule_no or literal_no."""
    columns = ["file_id", "basename", "line_no", "rule_id", "level", "message"]
    a = regex.select(*columns, F.struct(F.lit(0).alias("pass"), "file_id", "line_no", F.col("rule_no").alias("n")).alias("seq"))
    b = entropy.select(*columns, F.struct(F.lit(1).alias("pass"), "file_id", "line_no", F.col("literal_no").alias("n")).alias("seq"))
    return a.unionByName(b)


def distinct_rules(findings: DataFrame) -> DataFrame:
    """Rule ids with the place of their first finding."""
    return findings.groupBy("rule_id").agg(F.min("seq").alias("first"))


def sarif(findings: DataFrame, *, tool: str = "lumenscan", by: tuple[str, ...] = ()) -> DataFrame:
    """One SARIF document (column sarif) for each value of ``by``: by scanned project or file, say. A document is one
    row here, so this is for documents of bounded size; ``write_sarif`` writes one of any size."""
    result = _result()
    results = findings.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", result.alias("result")))).alias("r"))
    rules = findings.groupBy(*by, "rule_id").agg(F.min("seq").alias("seq")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "rule_id"))).alias("u"))
    both = results.join(rules, list(by)) if by else results.crossJoin(rules)  # one row each
    described = F.transform("u", lambda x: F.struct(x.rule_id.alias("id"), F.struct(x.rule_id.alias("text")).alias("shortDescription")))
    driver = F.struct(F.lit(tool).alias("name"), F.lit("https://example.com").alias("informationUri"), described.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("r", lambda x: x.result).alias("results"))
    return both.select(*by, F.to_json(F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs")), {"pretty": "true"}).alias("sarif"))


def _result() -> Column:
    place = F.struct(F.struct(F.col("basename").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region"))
    return F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))


def write_sarif(findings: DataFrame, folder: str, *, tool: str = "lumenscan") -> None:
    """One SARIF document of any size, as a folder of fragments that give it when put together in order of their names
    (``cat folder/*``). Findings are sorted by range of seq and each task writes its own fragment, one finding a line; no row
    holds more than a finding, but the first fragment, which holds the rules. The fragments are written aside and appear under
    ``folder`` by one rename, so a reader never sees half a document. No findings give an empty list of results."""
    spark = findings.sparkSession
    staging = f"{folder.rstrip('/')}._writing"
    scratch.delete(spark, staging)
    rules = [r["rule_id"] for r in distinct_rules(findings).orderBy("first").select("rule_id").collect()]  # some dozens: the scan's rules
    # The first row of a partition begins a fragment; the others bring the comma before them.
    ranged = findings.repartitionByRange("seq").sortWithinPartitions("seq").select(F.monotonically_increasing_id().alias("n"), F.to_json(_result()).alias("json"))
    ranged.select(F.when(F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.col("json")).otherwise(F.concat(F.lit(","), "json")).alias("value")).write.text(staging)
    described = [{"id": r, "shortDescription": {"text": r}} for r in rules]
    driver = {"name": tool, "informationUri": "https://example.com", "rules": described}
    head = json.dumps({"version": SARIF_VERSION, "$schema": SARIF_SCHEMA, "runs": [{"tool": {"driver": driver}, "results": []}]}, indent=2)
    at = head.rindex("[]") + 1
    fs = scratch.files_of(spark, staging)
    parts = [p for p in fs.names() if p.startswith("part-") and fs.size(p)]
    for p in fs.names():
        if p not in parts:
            fs.delete(p)
    for k, p in enumerate(parts):
        fs.rename(p, f"{2 * k + 2:08d}-results.json")
        if k:
            fs.write(f"{2 * k + 1:08d}-comma.json", ",")
    fs.write("00000001-head.json" if parts else "00000000-head.json", head[:at])
    fs.write("99999999-end.json", head[at:])
    scratch.delete(spark, folder)
    fs.move(folder)


def write_text(documents: DataFrame, column: str, folder: str) -> None:
    """Documents as text files."""
    documents.select(column).write.text(folder)


def with_taint(issues: DataFrame, taint_issues: DataFrame, redos: DataFrame | None = None) -> DataFrame:
    """The classic pass's issues with the taint pass's appended behind them, file by file. ``taint_issues``: file_id,
    message, line, and patched (null without a patch); ``redos``: the same of nested quantifiers."""
    more = taint_issues if redos is None else taint_issues.unionByName(redos)
    text = F.concat("message", F.when(F.col("patched").isNotNull(), " [AUTO-FIX AVAILABLE in CLI]").otherwise(""))
    end = F.struct(F.lit(2**31 - 1).alias("pos"), F.col("line").cast("int").alias("rule"))
    more = more.select("file_id", F.lit("security").alias("type"), F.lit("TAINT").alias("rule_id"), text.alias("message"), F.col("line").cast("int").alias("line_no"), end.alias("seq"))
    return issues.select(*more.columns).unionByName(more)


def file_report(files: DataFrame, issues: DataFrame, endpoints: DataFrame, complexity: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per file: path, complexity, issues in order, endpoints in order of discovery, error. A file with an error
    (``errors``: file_id, error) has nothing else, and the scan of the others goes on."""
    i = issues.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "rule_id", "message", "line_no"))), lambda x: F.struct(x.type.alias("type"), x.rule_id.alias("rule_id"), x.message.alias("message"), x.line_no.alias("line"))).alias("issues"))
    first = endpoints.groupBy("file_id", "endpoint").agg(F.min("seq").alias("seq"))
    e = first.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "endpoint"))), lambda x: x.endpoint).alias("endpoints"))
    wrong = files.select("file_id", "error") if errors is None and "error" in files.columns else errors
    out = files.select("file_id", "path").join(complexity, "file_id", "left").join(i, "file_id", "left").join(e, "file_id", "left")
    out = out.withColumn("error", F.lit(None).cast("string")) if wrong is None else out.join(wrong, "file_id", "left")
    read = F.col("error").isNull()
    return out.select("file_id", "path", F.when(read, F.coalesce("complexity", F.lit(0))).alias("complexity"), *[F.when(read, F.col(c)).alias(c) for c in ("issues", "endpoints")], "error")


def text_report(report: DataFrame) -> DataFrame:
    """One text per file: its complexity, endpoints and threats, or its error."""
    of = lambda a, f: F.array_join(F.transform(a, f), "\n")
    threats = of("issues", lambda x: F.concat(F.lit("    - ["), F.upper(x.type), F.lit("] Line "), x.line.cast("string"), F.lit(": "), x.message))
    found = F.when(F.size("issues") > 0, F.concat(F.lit("  Threats:\n"), threats)).otherwise("  No threats found.")
    ends = F.when(F.size("endpoints") > 0, F.concat(F.lit("  Endpoints:\n"), of("endpoints", lambda x: F.concat(F.lit("    - "), x))))
    head = F.concat(F.lit("File: "), F.col("path"))
    whole = F.concat_ws("\n", head, F.concat(F.lit("  Complexity: "), F.col("complexity").cast("string")), ends, found)
    return report.select("path", F.when(F.col("error").isNotNull(), F.concat(head, F.lit("\n  Error: "), F.col("error"))).otherwise(whole).alias("text"))


def totals(report: DataFrame) -> DataFrame:
    """Files, complexity, issues and endpoints over all files."""
    n = lambda c: F.sum(F.coalesce(F.array_size(c), F.lit(0)))
    return report.agg(F.count("*").alias("total_files"), F.sum("complexity").alias("total_complexity"), n("issues").alias("total_issues"), n("endpoints").alias("total_endpoints"))


def table_report(report: DataFrame) -> DataFrame:
    """File, complexity, endpoints and threats as text cells; of a file with an error its error, and no complexity."""
    lines = lambda a: F.array_join(a, "\n")
    threats = F.transform("issues", lambda x: F.concat(F.lit("["), F.upper(x.type), F.lit("] "), x.message, F.lit(" (line "), x.line.cast("string"), F.lit(")")))
    return report.select("path", F.coalesce(F.col("complexity").cast("string"), F.lit("NaN")).alias("complexity"), F.coalesce(lines("endpoints"), F.lit("None")).alias("endpoints"), F.coalesce("error", lines(threats), F.lit("Secure")).alias("threats"))


def json_report(report: DataFrame) -> DataFrame:
    """One JSON text per file, as JSON lines."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))
