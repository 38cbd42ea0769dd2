"""One scan of a folder: dependencies, lines, taint and shape checks, secrets by entropy, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dependencies, entropy, fixes, heuristics, regex_rules, report, syntax_rules, taint, tokens
from ..sources import code

FIXES = {"COMMAND_INJECTION": fixes.command_fix, "REDOS": fixes.redos_fix, "SQL_INJECTION": fixes.sql_fix}


@dataclass
class Scan:
    """Results of ``scan``. Each is a table; ``release`` frees what they share."""

    files: DataFrame
    dependencies: DataFrame | None  # packages with look-alike names or advisories
    lines: DataFrame  # the report's rows: findings of the line rules, then secrets by entropy
    flows: DataFrame  # taint findings and uses of tainted values, with a reachability label
    issues: DataFrame  # issues of the flows and of nested quantifiers, with the line as fixed where there is a fix
    patches: DataFrame  # one patch for each file that has fixes, with its diff
    shapes: DataFrame  # findings that need no taint, by channel
    state: DataFrame  # names that hold request data
    sarif: DataFrame  # the report of each file as one JSON text (file_id, sarif)
    parsed: syntax_rules.Parsed

    def release(self) -> None:
        self.parsed.release()


def fix_by_kind(line: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, f in FIXES.items():
        out = F.when(kind == name, f(line)).otherwise(out)
    return out


def issues_of(parsed: syntax_rules.Parsed, found: DataFrame, shapes: DataFrame, sinks: DataFrame | None = None) -> DataFrame:
    """file_id, type, message, line, severity, kind, patched (the line as fixed, else null): what the taint pass hands on to
    reports. ``fixes.file_patches`` makes one patch a file of it."""
    columns = ["file_id", "type", "message", "line", "severity"]
    sunk = taint.issues(found, sinks).select(*columns, F.when(F.col("sink_type").isin(*FIXES), F.col("sink_type")).alias("kind"))
    redos = shapes.filter("rule_id = 'REDOS'").select("file_id", F.lit("security").alias("type"), F.lit("Pattern repeats a group that repeats itself").alias("message"), F.col("line_no").alias("line"), F.lit("high").alias("severity"), F.lit("REDOS").alias("kind"))
    return fixes.fixed_at(sunk.unionByName(redos), tokens.lines(parsed.cut), fix_by_kind)  # each is of a call, so its line is there


def scan(spark: SparkSession, folder: str, *, rules_folder: str | None = None, manifests: DataFrame | None = None, advisories: DataFrame | None = None, report_folder: str | None = None) -> Scan:
    """Scans all source files below ``folder``. ``rules_folder``: user rules in YAML. ``manifests`` (package_json) and
    ``advisories`` feed the dependency check. ``report_folder``: where the report of all files is written, as
    fragments of one JSON text (``report.write_sarif``)."""
    files = code.crawl(spark, folder)
    return scan_files(files, rules=code.custom_rules(spark, rules_folder) if rules_folder else None, manifests=manifests, advisories=advisories, report_folder=report_folder)


def scan_files(files: DataFrame, *, rules: DataFrame | None = None, manifests: DataFrame | None = None, advisories: DataFrame | None = None, report_folder: str | None = None) -> Scan:
    """The same for a table of files: file_id, path, basename, content."""
    sinks, sources = (None, None) if rules is None else (code.rules_of(rules, "SINK"), code.rules_of(rules, "SOURCE"))
    found = dependencies.scan(code.manifest_packages(manifests), advisories) if manifests is not None and advisories is not None else None
    rows = regex_rules.lines(files.select("file_id", "basename", "content"))
    lines = report.in_report_order(regex_rules.scan_lines(rows), entropy.secrets(rows))
    p = syntax_rules.prepare(files)
    flows = taint.track(p, sinks=sinks, sources=sources)
    label = F.when(code.is_test_file(F.col("basename")), "test").otherwise("reachable")
    labelled = flows.join(files.select("file_id", "basename"), "file_id").withColumn("reachability", label)
    shapes = heuristics.scan(p)
    sarif = report.sarif(lines, by=("file_id",))
    if report_folder is not None:
        report.write_sarif(lines, report_folder)
    issues = issues_of(p, flows, shapes, sinks)
    return Scan(files, found, lines, labelled, issues, fixes.file_patches(issues, files), shapes, taint.state(p, sinks=sinks, sources=sources), sarif, p)


def classic_report(files: DataFrame) -> DataFrame:
    """The classic pass's report of each file: complexity, issues (the taint pass's behind the others), endpoints, error."""
    p = syntax_rules.prepare(files)
    # Each part is written before the next: the driver holds the plan of one part at a time.
    extra = p.write(issues_of(p, taint.track(p), heuristics.scan(p)).select("file_id", "message", "line", "patched"), "extra")
    issues, errors = p.write(syntax_rules.scan(p), "issues"), p.write(syntax_rules.errors(p), "errors")
    return report.file_report(files, report.with_taint(issues, extra), syntax_rules.endpoints(p), syntax_rules.complexity(p), errors)
