"""How far the sources of a language differ in their words: a divergence audit over an inverted index.

Each group (language, source) gives every kept term t the smoothed share p(t), in units of 1e-9. Two groups differ by the
sum of |p - q| over all V kept terms, and nearly all counts are zero. So every pair starts at V times the difference of the
two shares of a zero count, and only what departs from that is worked out. With a0 and b0 the shares of a zero count and
M the greater of them, a share a(t) is never under a0, and

    |a - b| - |a0 - b0|  =  (a - a0) + (b - b0) - 2 min(a - a0, M - a0) - 2 min(b - b0, M - b0) - 2 max(0, min(a, b) - M)

The first four terms need one group's postings only: sums by distinct share, looked up at M by a running sum. The last is
the correction that a term's posting list emits, for those pairs of its sources of which both stand above M; each task sums
by pair before anything is shuffled. Arithmetic is exact: decimals up to the shares, long integers from there.

Text is cut into terms once, in Arrow batches: a task holds the counts of at most ``max_held`` (group, term) and hands them
on when it has more. What is shuffled are counts by group and term; texts stay where they are. No step brings a language,
a source or a term with all its occurrences into one task: a term's list has one entry for each source, and the top terms
of a group are cut to ``top`` in every task before they meet. Pairs of sources are the result itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bytes of a text: A-Z in lower case, other ASCII that is no letter as a space, all bytes of other characters as they are.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


@dataclass
class Audit:
    """Parameters. min_docs: documents of a language that a kept term is in at least; smooth: added to every count;
    unit: shares are whole numbers of 1 / unit; top: ranks of the term part."""

    min_docs: int = 30
    smooth: int = 5
    unit: int = 1_000_000_000
    top: int = 50
    max_held: int = 200_000


@dataclass
class Index:
    """kept: lang, source, term, n, lang_n (occurrences in the language). groups: gid, lang, source, size (occurrences of
    kept terms), lang_size, terms (V), zero (share of a zero count, null where V is 0); n_groups of them."""

    kept: DataFrame
    groups: DataFrame
    n_groups: int


def _count(max_held: int):
    """Arrow batches of (lang, source, text) to counts by group and term, summed within the task as far as memory goes."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n.keys()), pa.binary()).cast(pa.string())
            same = [pa.array([v] * len(n), pa.string()) for v in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        some = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                words = text.as_py().translate(_LETTERS).split()
                n, docs = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                docs.update(set(words))
                some += len(n) - before
                if some > max_held:
                    yield from rows(held)
                    held, some = {}, 0
        yield from rows(held)

    return run


def build(docs: DataFrame, a: Audit | None = None, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> Index:
    """The index of ``docs``. Null text, language and source are the empty string; a language without kept terms keeps its
    groups; an empty table has none. Rows count as documents, repeated ones too."""
    a = a or Audit()
    spark = docs.sparkSession
    texts = docs.select(common.text_of(lang_col), common.text_of(source_col), common.text_of(text_col)).toDF("lang", "source", "text")
    schema = "lang string, source string, term string, n bigint, n_docs bigint"
    with common.batches_of(spark, 500):
        counts = texts.mapInArrow(_count(a.max_held), schema)
        # Dealt out by term, which serves the sums by source as well as those by language.
        by_term = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
        w = Window.partitionBy("lang", "term")
        kept = by_term.withColumns({"lang_docs": F.sum("n_docs").over(w), "lang_n": F.sum("n").over(w), "head": F.row_number().over(w.orderBy("source")) == 1}).filter(F.col("lang_docs") >= a.min_docs)
        kept = common.materialise(kept.select("lang", "source", "term", "n", "lang_n", "head"), "audit-kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("head").alias("terms"))
    groups = texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "lang_size", "terms"])
    groups = groups.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "size", "lang_size", "terms", share(F.lit(0), F.col("size"), F.col("terms"), a).alias("zero"))
    groups = common.materialise(groups, "audit-groups")
    return Index(kept.drop("head"), groups, groups.count())


def share(n: Column, size: Column, terms: Column, a: Audit) -> Column:
    """1 + floor(unit * (n + smooth) / (size + smooth * terms)), exactly; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(a.unit).cast("decimal(15,0)") * (wide(n) + F.lit(a.smooth).cast("decimal(5,0)"))
    below = F.nullif(wide(size) + F.lit(a.smooth).cast("decimal(5,0)") * terms.cast("decimal(15,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _shares(index: Index, a: Audit) -> DataFrame:
    """Postings with shares: gid, lang, source, term, zero, p (the group's), q (the language's)."""
    g = common.broadcast_if(index.groups, index.n_groups, 200)
    rows = index.kept.join(g, ["lang", "source"])
    return rows.select("gid", "lang", "source", "term", "zero", share(F.col("n"), F.col("size"), F.col("terms"), a).alias("p"), share(F.col("lang_n"), F.col("lang_size"), F.col("terms"), a).alias("q"))


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows if top is None else rows.filter(F.col("rank") <= top)


def terms(index: Index, a: Audit | None = None) -> DataFrame:
    """lang, source, item (a term that the source uses more than its language), value, rank up to ``top``."""
    a = a or Audit()
    above = _shares(index, a).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above, a.top)


def _low(index: Index, own: DataFrame) -> DataFrame:
    """gid, other, low: the sum over the group's postings of min(p, M) - zero, for the others whose zero share M is above.

    Distinct shares and the values to look up stand in one order; running sums over it answer all of them."""
    bars = own.groupBy("gid", "zero", "p").agg(F.count("*").alias("m")).select("gid", F.col("p").alias("at"), F.lit(None).cast("long").alias("other"), "m", (F.col("m") * (F.col("p") - F.col("zero"))).alias("mass"), "zero")
    g, o = index.groups, index.groups.select(F.col("gid").alias("other"), "lang", F.col("zero").alias("at"))
    asked = g.join(o, "lang").filter(F.col("at") > F.col("zero")).select("gid", "at", "other", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("mass"), "zero")
    upto = Window.partitionBy("gid").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = bars.unionByName(asked).withColumns({"under": F.sum("m").over(upto), "sum_under": F.sum("mass").over(upto)})
    run = run.join(own.groupBy("gid").agg(F.count("*").alias("all")), "gid").filter(F.col("other").isNotNull())
    return run.select("gid", "other", (F.col("sum_under") + (F.col("all") - F.col("under")) * (F.col("at") - F.col("zero"))).alias("low"))


def _met(own: DataFrame) -> DataFrame:
    """gid, other (gid < other), met: the sum of max(0, min(p, q) - M) over the terms that both use. The corrections of
    the postings: only those that are not zero."""
    lists = own.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "zero"))).alias("l")).filter(F.size("l") > 1)
    pairs = lists.select("l", F.posexplode("l").alias("k", "a")).select("a", F.explode(F.slice("l", F.col("k") + 2, F.size("l"))).alias("b"))
    over = F.least("a.p", "b.p") - F.greatest("a.zero", "b.zero")
    return pairs.select(F.col("a.gid").alias("gid"), F.col("b.gid").alias("other"), over.alias("over")).filter("over > 0").groupBy("gid", "other").agg(F.sum("over").alias("met"))


def pairs(index: Index, a: Audit | None = None) -> DataFrame:
    """lang, source, item (each other source of the language), value (the sum of differences), rank."""
    own = _shares(index, a or Audit()).select("gid", "lang", "term", "zero", "p")
    rise = own.groupBy("gid").agg(F.sum(F.col("p") - F.col("zero")).alias("rise"))
    g = index.groups.join(rise, "gid", "left").fillna(0, ["rise"])
    o = g.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("zero").alias("o_zero"), F.col("rise").alias("o_rise"))
    all_ = g.join(o, "lang").filter("gid <> other").withColumns({"x": F.least("gid", "other"), "y": F.greatest("gid", "other")})
    # Of two zero shares one is above at most: one of the pair's groups has a low part.
    low = _low(index, own).select(F.least("gid", "other").alias("x"), F.greatest("gid", "other").alias("y"), "low")
    met = _met(own).withColumnsRenamed({"gid": "x", "other": "y"})
    all_ = all_.join(low, ["x", "y"], "left").join(met, ["x", "y"], "left").fillna(0, ["low", "met"])
    start = F.col("terms") * F.abs(F.col("zero") - F.col("o_zero"))
    value = F.coalesce(start + F.col("rise") + F.col("o_rise") - 2 * F.col("low") - 2 * F.col("met"), F.lit(0).cast("long"))
    return _ranked(all_.select("lang", "source", "item", value.alias("value")))


def audit(docs: DataFrame, a: Audit | None = None, **columns) -> DataFrame:
    """Both parts: lang, source, part (pair or term), item, value, rank. See ``build`` for odd input; ties of value go by
    item in UTF-8 order."""
    a = a or Audit()
    index = build(docs, a, **columns)
    parts = [x.withColumn("part", F.lit(name)) for name, x in (("pair", pairs(index, a)), ("term", terms(index, a)))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


# Every pair over all terms, the plain way.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.size + 5 * v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 5)) // (any_value(s)::HUGEINT + 5 * any_value(v)) AS q
      FROM (SELECT c.*, sum(c.n) OVER (PARTITION BY c.lang) AS s, v.v AS v FROM c JOIN v USING (lang)) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
