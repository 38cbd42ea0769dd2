"""What a report costs the driver and the shuffles: the size of its plans, and what they carry."""

import random
import re

import pytest
from lumenscan.operators import fixes, heuristics, syntax_rules, taint
from lumenscan.operators import tokens as tk
from lumenscan.plans import full_scan

PROGRAM = "const q = req.query.a;\ndb.query(`x ${q}`);\nnew RegExp('(a+)+b');\nh.request({rejectUnauthorized: false, rejectUnauthorized: false});"


def files_of(spark, contents):
    return spark.createDataFrame([(str(k), f"{k}.js", c) for k, c in enumerate(contents)], "file_id string, path string, content string")


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parsed(spark):
    return syntax_rules.prepare(files_of(spark, [PROGRAM]))


def test_plans_stay_small(spark, parsed):
    """The driver of a large report ran out of memory by plans of some 300 to 400 operators."""
    report = full_scan.classic_report(files_of(spark, [PROGRAM]))
    sizes = [len(plan(x).strip().split("\n")) for x in (syntax_rules.scan(parsed), taint._inputs(parsed, None, None), report)]
    assert max(sizes) < 200, sizes
    row = report.first()
    assert [i.rule_id for i in row.issues] == ["TLS_OFF", "TLS_OFF", "TAINT", "TAINT"] and [i.line for i in row.issues] == [4, 4, 2, 3]


def test_contents_are_not_shuffled(parsed):
    assert "content#" not in plan(full_scan.issues_of(parsed, taint.track(parsed), heuristics.scan(parsed)))
    assert not re.search(r"Project \[[^\n]*(?<=[ \[])content#\d+[,\]]", plan(syntax_rules.errors(parsed)))


def test_fixes_by_lines_are_those_by_contents(spark):
    rng = random.Random(3)
    parts = ["cp.exec(x);", "db.query(`a ${b}`);", "/* two\nlines */", "`t\n${y}\n` + z;", "\r\n", "\n", "// c\n", "new RegExp('(a*)*');", " ", "'open", "x"]
    contents = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(80)] + [None, "", "a;" * 30_000 + "\n" + "b;" * 30_000]
    files = files_of(spark, contents)
    p = syntax_rules.prepare(files)
    lines = [(r.file_id, r.line, r.text) for r in tk.lines(p.cut).collect()]
    assert all(contents[int(f)].split("\n")[n - 1] == t for f, n, t in lines)
    began = {(r.file_id, r.line) for r in p.cut.select("file_id", "line").collect()}
    assert sorted(began) == sorted((f, n) for f, n, _ in lines) and len(began) > 100
    asked = spark.createDataFrame([(f, n, k) for f, n in began for k in ("REDOS", "COMMAND_INJECTION", "SQL_INJECTION", None)], "file_id string, line int, kind string")
    by = [sorted(map(str, found.collect())) for found in (fixes.fixed_lines(asked, files, full_scan.fix_by_kind), fixes.fixed_at(asked, tk.lines(p.cut), full_scan.fix_by_kind))]
    assert by[0] == by[1]
