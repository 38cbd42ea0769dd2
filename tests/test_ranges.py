"""Versions and their ranges against brute force, advisories in the OSV format, the written SARIF report."""

import json
import random
from functools import cmp_to_key

from pyspark.sql import functions as F

from lumenscan.operators import dependencies, report
from lumenscan.sources import advisories


def compare(a, b):
    """Semantic versions by their rules, part by part."""
    def cut(v):
        core, _, pre = v.lstrip("v").split("+")[0].partition("-")
        numbers = [int(x) for x in core.split(".")]
        return numbers + [0] * (3 - len(numbers)), pre.split(".") if pre else None

    (x, p), (y, q) = cut(a), cut(b)
    if x != y:
        return -1 if x < y else 1
    if p is None or q is None:
        return (p is None) - (q is None)
    for i, j in zip(p, q, strict=False):
        if i != j:
            if i.isdigit() and j.isdigit():
                return -1 if int(i) < int(j) else 1
            if i.isdigit() != j.isdigit():
                return -1 if i.isdigit() else 1
            return -1 if i < j else 1
    return (len(p) > len(q)) - (len(p) < len(q))


def versions(rng, n):
    tags = ["", "", "", "-alpha", "-alpha.1", "-alpha.beta", "-beta", "-beta.2", "-beta.11", "-rc.1", "-0", "-x-y", "-1a", "-alpha.1.0"]
    return [f"{rng.randrange(12)}.{rng.choice([0, 1, 9, 10, 100])}.{rng.randrange(3)}{rng.choice(tags)}" for _ in range(n)]


def test_version_keys_sort_as_versions_do(spark):
    rng = random.Random(1)
    some = sorted(set(versions(rng, 400) + ["1", "1.2", "v2.0.0", "99999999999999999999.0.0", "0.0.0"]))
    keys = {r.v: r.k for r in spark.createDataFrame([(v,) for v in some], "v string").select("v", dependencies.version_key(F.col("v")).alias("k")).collect()}
    assert all((keys[a] > keys[b]) - (keys[a] < keys[b]) == compare(a, b) for a in some for b in some)
    odd = ["", "latest", "1.2.3.4", "a.b", "1.0.0+build", "01.2.3", None, "1.x"]
    got = {r.v: r.k for r in spark.createDataFrame([(v,) for v in odd], "v string").select("v", dependencies.version_key(F.col("v")).alias("k")).collect()}
    assert [got[v] is None for v in odd] == [True, True, True, True, False, False, True, False]
    assert got["1.0.0+build"] == keys["1"] and sorted(some, key=cmp_to_key(compare))[0].startswith("0.0.0")


def test_ranges_against_brute_force(spark):
    rng = random.Random(2)
    packages = [(k, rng.choice(["a", "a", "a", "b", "c"]), v) for k, v in enumerate(versions(rng, 300))] + [(900, "a", "latest"), (901, "a", None), (902, None, "1.0.0"), (903, "b", "1.0.0"), (904, "b", "1.0.0")]
    ends = versions(rng, 80)
    ranges = [(str(k), rng.choice("aabd"), rng.choice([None, *ends]), rng.random() < 0.5, rng.choice([None, *ends]), rng.random() < 0.5) for k in range(150)]
    ranges += [("same", "b", "1.0.0", False, "1.0.0", False), ("none", "b", "1.0.0", True, "1.0.0", False), ("bad", "a", "what", False, None, False), ("all", "a", None, None, None, None)]
    p = spark.createDataFrame(packages, "id int, pkg string, version string")
    r = spark.createDataFrame(ranges, "range_id string, pkg string, low string, low_open boolean, high string, high_open boolean")
    got = sorted((x.pkg, x.version, x.range_id) for x in dependencies.affected(p, r).collect())
    want = set()
    for _, pkg, v in packages:
        for rid, other, lo, lo_open, hi, hi_open in ranges:
            if pkg == other and v not in (None, "latest") and lo != "what":
                if (lo is None or compare(v, lo) > (0 if lo_open else -1)) and (hi is None or compare(v, hi) < (0 if hi_open else 1)):
                    want.add((pkg, v, rid))
    assert got == sorted(want)
    assert dependencies.affected(p.limit(0), r).count() == 0 and dependencies.affected(p, r.limit(0)).count() == 0


def test_advisories_in_the_osv_format(spark):
    def entry(name, events, versions=(), ecosystem="npm", **more):
        return json.dumps({"id": name, "aliases": [f"CVE-{name}"], "affected": [{"package": {"name": "p", "ecosystem": ecosystem}, "ranges": [{"type": "SEMVER", "events": events}], "versions": list(versions)}], **more})

    texts = [
        entry("A", [{"introduced": "0"}, {"fixed": "1.2.0"}, {"introduced": "2.0.0"}, {"fixed": "2.0.5"}]), entry("B", [{"last_affected": "3.1.0"}, {"introduced": "3.0.0-rc.1"}], ["9.9.9"]),
        entry("C", [{"introduced": "4.0.0"}]), entry("D", [{"introduced": "0"}], ecosystem="PyPI"), entry("E", [{"introduced": "0"}], withdrawn="2020-01-01"), "{no"]
    ranges = advisories.from_json(spark.createDataFrame([(t,) for t in texts], "content string"))
    asked = {"1.1.9": "A", "1.2.0": "", "2.0.4": "A", "2.0.5": "", "3.0.0-rc.0": "", "3.0.0-rc.1": "B", "3.1.0": "B", "3.1.1": "", "4.0.0": "C", "9.9.9": "BC"}
    p = spark.createDataFrame([(k, 0, "p", "^" + v) for k, v in enumerate(asked)] + [(99, 1, "lo-dash", "1.0.0")], "id int, ord int, pkg string, version string")
    found = {r.version: "".join(sorted(r.vulnerabilities)) for r in dependencies.scan(p, ranges).filter("NOT is_typosquatting").collect()}
    assert found == {v: a for v, a in asked.items() if a}


def findings(spark, n):
    return spark.range(n).select(F.struct(F.lit(0).alias("pass"), F.col("id").alias("file_id")).alias("seq"), F.concat(F.lit("R"), (F.col("id") % 7).cast("string")).alias("rule_id"), F.lit("error").alias("level"), F.concat(F.lit('a "text" of '), "id").alias("message"), F.concat(F.lit("f"), "id", F.lit(".js")).alias("basename"), (F.col("id") % 100).cast("int").alias("line_no"))


def document(folder):
    return "".join(p.read_text() for p in sorted(folder.iterdir()) if not p.name.startswith("."))


def test_written_report_is_the_one_row_report(spark, tmp_path):
    for n in (0, 1, 500):
        rows = findings(spark, n).repartition(5)
        report.write_sarif(rows, f"file://{tmp_path}/r{n}")
        got = json.loads(document(tmp_path / f"r{n}"))
        if n:
            assert got == json.loads(report.sarif(rows).first().sarif)
        else:
            assert got["runs"][0]["results"] == [] and got["runs"][0]["tool"]["driver"]["rules"] == []
    report.write_sarif(findings(spark, 3), f"file://{tmp_path}/r500")  # takes the place of the older one
    assert len(json.loads(document(tmp_path / "r500"))["runs"][0]["results"]) == 3


def test_a_million_findings_in_small_rows(spark, tmp_path):
    report.write_sarif(findings(spark, 1_000_000), f"file://{tmp_path}/big")
    assert max(len(line) for p in (tmp_path / "big").iterdir() if not p.name.startswith(".") for line in p.open()) < 1000
    got = json.loads(document(tmp_path / "big"))["runs"][0]
    assert [int(r["message"]["text"].split()[-1]) for r in got["results"]] == list(range(1_000_000)) and len(got["tool"]["driver"]["rules"]) == 7
