"""Source files, rule files and manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename

# What each kind of crawl keeps and passes over.
SCAN_SUFFIXES, SCAN_SKIPS = (".js", ".ts"), ("node_modules",)
CLASSIC_SUFFIXES, CLASSIC_SKIPS = (".js", ".ts", ".jsx", ".tsx"), ("node_modules", ".git", "dist")

SOURCES = "file_id string, path string, basename string, content string"


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select(F.sha1("path").alias("file_id"), "path", basename(F.col("path")).alias("basename"), "content")


def crawl(spark: SparkSession, folder: str, *, classic: bool = False) -> DataFrame:
    """All source files below a folder, by suffix, without those in folders that are passed over."""
    suffixes, skips = (CLASSIC_SUFFIXES, CLASSIC_SKIPS) if classic else (SCAN_SUFFIXES, SCAN_SKIPS)
    glob = "*{" + ",".join(suffixes) + "}"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    below = F.split(F.replace(path, F.lit(folder.rstrip("/") + "/"), F.lit("\n")), "\n")
    kept = rows.select(F.col("value").alias("content"), path.alias("path"), F.element_at(below, -1).alias("below"))
    for name in skips:
        kept = kept.filter(~F.array_contains(F.split("below", "/"), name))
    return _shape(kept)


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """A single file, whatever its suffix."""
    return _shape(spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path")))


def from_strings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Code held in memory: path -> content."""
    return _shape(spark.createDataFrame(list(texts.items()), "path string, content string"))


def from_string(spark: SparkSession, text: str, path: str = "virtual-file.js") -> DataFrame:
    """One text of code; a name of its own stands for the file it has not."""
    return from_strings(spark, {path: text})


def custom_rules(spark: SparkSession, folder: str) -> DataFrame:
    """User rules of all YAML files in a folder: id, description, type, severity, target_pattern, ord.

    Rules need id, type and targetPattern; severity is 5 where it is missing or zero. A missing folder or
    broken file gives no rules. Rules are a configuration of some dozens of rows."""
    import yaml
    from pyspark.errors import PySparkException

    found = []
    try:
        files = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(folder, wholetext=True).select(F.col("_metadata.file_path"), "value").orderBy("file_path").collect()
    except PySparkException:
        files = []
    for f in files:
        try:
            rules = (yaml.safe_load(f["value"]) or {}).get("rules")
        except (yaml.YAMLError, AttributeError):
            continue
        for r in rules if isinstance(rules, list) else []:
            if isinstance(r, dict) and r.get("id") and r.get("type") and r.get("targetPattern"):
                found.append((str(r["id"]), r.get("description") or "", r["type"], float(r.get("severity") or 5), str(r["targetPattern"]), len(found)))
    return spark.createDataFrame(found, "id string, description string, type string, severity double, target_pattern string, ord int")


def rules_of(rules: DataFrame, kind: str) -> DataFrame:
    """Rules of one type (SINK or SOURCE) under the names that taint tracking uses."""
    name = {"SINK": "function_name", "SOURCE": "source_pattern"}[kind]
    return rules.filter(F.col("type") == kind).select(F.col("target_pattern").alias(name), "id", "severity", "description", "ord")


def manifest_packages(manifests: DataFrame, content: str = "package_json") -> DataFrame:
    """One row per package of a package.json: the other columns, ord, pkg, version. Development versions
    override others of the same name but keep the first place. A manifest that is no JSON raises."""
    keep = [c for c in manifests.columns if c != content]
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = manifests.withColumn("m", F.from_json(content, schema, {"mode": "FAILFAST"}))
    none = F.create_map().cast("map<string,string>")
    deps, dev = F.coalesce("m.dependencies", none), F.coalesce("m.devDependencies", none)
    merged = F.concat(
        F.transform(F.map_entries(deps), lambda e: F.struct(e.key.alias("pkg"), F.coalesce(F.element_at(dev, e.key), e.value).alias("version"))),
        F.transform(F.filter(F.map_entries(dev), lambda e: ~F.map_contains_key(deps, e.key)), lambda e: F.struct(e.key.alias("pkg"), e.value.alias("version"))))
    return parsed.select(*keep, F.posexplode(merged).alias("ord", "d")).select(*keep, "ord", "d.*")


def is_test_file(name: Column) -> Column:
    """Whether a base name marks a test or mock."""
    return F.lower(name).rlike(r"\.test\.|\.spec\.|test|mock")
