"""Dependency checks: look-alike names, and known advisories by version or by range of versions.

Versions get a text that sorts as semantic versions do, so a range is an interval of texts. Versions and the ends of a package's
ranges stand in one order; a version's place among the ends is a number, a range an interval of numbers. An interval is the
union of few dyadic ones (two for each doubling of the number of ends), a number lies in one dyadic interval for each doubling, and
the two meet by an equi-join: a package with many ranges and many versions is never joined all by all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Look-alike names and what was meant.
LOOK_ALIKES = {
    "lo-dash": "lodash",
    "crossenv": "cross-env",
    "node-fetchs": "node-fetch",
    "expresss": "express",
    "electorn": "electron",
}


def look_alikes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOOK_ALIKES.items()), "pkg string, meant string")


def clean_version(version: Column) -> Column:
    return F.regexp_replace(version, r"[\^~>]", "")


def typosquats(packages: DataFrame) -> DataFrame:
    """Packages whose name is a known look-alike, with what was meant."""
    return packages.join(F.broadcast(look_alikes(packages.sparkSession)), "pkg")


def advisories_of(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages with advisories: version without range marks, and the ids (else first alias, else a
    placeholder) in the advisories' order. ``advisories``: pkg, version, id, aliases, ord."""
    rest = packages.join(F.broadcast(look_alikes(packages.sparkSession)), "pkg", "left_anti").withColumn("version", clean_version(F.col("version")))
    name = F.coalesce("id", F.get("aliases", F.lit(0)), F.lit("Unknown CVE"))
    known = advisories.select("pkg", "version", F.struct(F.col("ord").alias("at"), name.alias("name")).alias("advisory"))
    found = rest.join(known, ["pkg", "version"]).groupBy(*packages.columns).agg(F.array_sort(F.collect_list("advisory")).alias("advisories"))
    return found.withColumn("vulnerabilities", F.transform("advisories", lambda x: x["name"])).drop("advisories")


VERSION = r"^[v=\s]*(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]*)?\s*$"


def _number(digits: Column) -> Column:
    """Digits as a text that sorts by value: their number first."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def version_key(version: Column) -> Column:
    """A text that sorts as semantic versions do: numbers by value, missing ones as 0, a pre-release before its release and by
    its parts (numbers before names, fewer parts first). Build marks do not count. Null for what is no version."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(version, VERSION, k), "[xX*]", "0"), F.lit("")), F.lit("0"))
    pre = F.regexp_extract(version, VERSION, 4)
    each = F.transform(F.split(pre, r"\.", -1), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x), F.lit("!"))).otherwise(F.concat(F.lit("1"), x, F.lit("!"))))
    end = F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(each, ""), F.lit(" ")))
    return F.when(version.rlike(VERSION), F.concat(_number(part(1)), _number(part(2)), _number(part(3)), end))


def _dyadic(a: Column, b: Column) -> Column:
    """The whole numbers from a to below b as dyadic intervals (level, node)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def halve(s: Column, level: Column) -> Column:
        odd = lambda x: (x % 2 == 1) & (s.a < s.b)
        node = lambda x: F.array(F.struct(level.cast("int").alias("level"), x.cast("long").alias("node")))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        a2 = s.a + F.when(odd(s.a), 1).otherwise(0)
        right = (s.b % 2 == 1) & (a2 < s.b)
        b2 = s.b - F.when(right, 1).otherwise(0)
        out = F.concat(s.out, F.when(odd(s.a), node(s.a)).otherwise(none), F.when(right, node(s.b - 1)).otherwise(none))
        return F.struct(F.shiftright(a2, 1).alias("a"), F.shiftright(b2, 1).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, halve, lambda s: s.out)


def affected(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pkg, version (distinct, as given) and range_id of the ``ranges`` that hold it. ``ranges``: range_id, pkg, low, low_open,
    high, high_open; a null end is none. Versions and ends that are no versions are in no range; an empty or reversed range
    holds nothing; repeated versions count once."""
    points = packages.select("pkg", "version").distinct().withColumn("key", version_key(clean_version(F.col("version")))).filter("key IS NOT NULL")
    r = ranges.withColumns({"lo": F.concat(version_key(F.col("low")), F.when(F.coalesce("low_open", F.lit(False)), "1").otherwise("0")), "hi": F.concat(version_key(F.col("high")), F.when(F.coalesce("high_open", F.lit(False)), "0").otherwise("1"))})
    r = r.filter("(low IS NULL OR lo IS NOT NULL) AND (high IS NULL OR hi IS NOT NULL)").select("range_id", "pkg", "lo", "hi")
    ends = r.select("pkg", F.explode(F.array("lo", "hi")).alias("at")).filter("at IS NOT NULL").distinct()
    # A version stands before the ends that it is not beyond: its number is how many ends are at or before it.
    places = ends.select("pkg", "at", F.lit(1).alias("is_end"), F.lit(None).cast("string").alias("version")).unionByName(points.select("pkg", F.concat("key", F.lit("0")).alias("at"), F.lit(0).alias("is_end"), "version"))
    upto = Window.partitionBy("pkg").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = places.withColumns({"n": F.sum("is_end").over(upto), "all": F.sum("is_end").over(Window.partitionBy("pkg"))})
    ranks = numbered.filter("is_end = 1").select("pkg", "at", "n")
    spans = r.join(ranks.select("pkg", F.col("at").alias("lo"), F.col("n").alias("a")), ["pkg", "lo"], "left").join(ranks.select("pkg", F.col("at").alias("hi"), F.col("n").alias("b")), ["pkg", "hi"], "left")
    spans = spans.select("range_id", "pkg", F.explode(_dyadic(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(1 << 40)))).alias("d")).select("range_id", "pkg", "d.level", "d.node")
    # Levels above those of the package's ends hold no bounded interval; an open end reaches them by its own nodes.
    own = numbered.filter("is_end = 0").select("pkg", "version", "n", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("level")).withColumn("node", F.expr("shiftright(CAST(n AS BIGINT), level)"))
    return own.join(spans, ["pkg", "level", "node"]).select("pkg", "version", "range_id")


def range_advisories(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Packages with advisories by range, like ``advisories_of``. ``ranges``: those of ``affected`` with id, aliases, ord."""
    rest = packages.join(F.broadcast(look_alikes(packages.sparkSession)), "pkg", "left_anti")
    name = F.coalesce("id", F.get("aliases", F.lit(0)), F.lit("Unknown CVE"))
    hits = affected(rest, ranges).join(ranges.select("range_id", F.struct(F.col("ord").alias("at"), name.alias("name")).alias("advisory")), "range_id")
    # An advisory of several ranges is told once.
    by_version = hits.groupBy("pkg", "version").agg(F.array_sort(F.collect_set("advisory")).alias("advisories"))
    found = rest.join(by_version, ["pkg", "version"]).withColumn("version", clean_version(F.col("version")))
    return found.withColumn("vulnerabilities", F.transform("advisories", lambda x: x["name"])).drop("advisories")


def scan(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Both checks in report order: look-alikes first, then advisories, each as in the manifest.
    Columns: those of ``packages``, vulnerabilities array, is_typosquatting, rank (0, then 1). ``advisories`` name single versions
    (``advisories_of``) or ranges (``range_advisories``)."""
    bad = typosquats(packages).withColumn("vulnerabilities", F.array(F.concat(F.lit("Look-alike name: meant is "), "meant"))).drop("meant")
    known = (range_advisories if "range_id" in advisories.columns else advisories_of)(packages, advisories)
    return bad.select(*packages.columns, "vulnerabilities", F.lit(True).alias("is_typosquatting"), F.lit(0).alias("rank")).unionByName(
        known.select(*packages.columns, "vulnerabilities", F.lit(False).alias("is_typosquatting"), F.lit(1).alias("rank")))
