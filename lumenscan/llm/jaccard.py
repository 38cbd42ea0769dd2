"""N-gram Jaccard join with set-relation skipping.

Exact: every pair of texts whose shingle sets have a Jaccard similarity of at least the
threshold ends in one class, whatever the size of the groups; no pair list of a group is made.

1. Equal sets become one class (digest of the sorted set), so copies are gone from here on.
2. Shingles get a global order, rare ones first. A bounded sketch counts, over all texts, the
   shingles that repeat within a task's own texts; it only shapes the order, any order is right.
3. Of a set of n shingles the first n - ceil(t n) + 1 are indexed: two sets that reach the
   threshold t share one of these. Entries travel packed in 16 bytes (48 bits of the shingle's hash, its
   place, the set), dealt by shingle, and are written once. A task first joins
   its own entries of a shingle and passes one on, so no list grows with a group of copies.
   Only shingles of two or more sets leave the index.
4. Skipping by place. Sets of n and m shingles must share o = ceil(t (n + m) / (1 + t)), so the first
   shingle they share stands at place n - o at most in the one, m - o in the other. The smaller set
   of a pair so needs an early entry (place up to n - ceil(2 t n / (1 + t)), about n / 7): lists without early entries
   are skipped whole. Rare shingles come first, so what a group of copies shares stands late.
5. In each list the most central set, the one whose shingles others share, is the hub. Each set is
   compared with the hub it shares most shingles with (``rounds`` times, with hubs of other classes
   than its own). Sets linked to a hub are answered by it: their pairs lie in one class already.
6. What is left are lists whose sets lie in several classes. Early entries are joined with entries of
   sets of like or larger size, by blocks of size, skipping pairs by sizes, places, shingles that no
   other set has, and by the answers of a common hub h: x and y share at most
   min(|hx|, |hy|) + min(|x| - |hx|, |y| - |hy|), and their distances from h differ by 1 - t at most.
7. Answers from answers: a set near its hub keeps its difference from the hub. Of two sets of one hub
   the overlap follows from their differences, without the texts. Other pairs are compared on sets
   made again from the texts concerned. Both are exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components
from .shingles import sets

WIDTH, PERCENT = 5, 75
BITS, SLICE = 22, 1 << 16  # the sketch: 4 MB, in slices
CHUNK = 400_000  # entries that a task joins by itself
PART = 200_000  # entries of a part of the index, on average
TOKEN, PLACE = 48, 16  # bits of an entry: of its shingle's hash, and of its place, where later ones count as the last


def prefix(n, percent: int = PERCENT):
    """How many of a set's n shingles are indexed."""
    return n - (percent * n + 99) // 100 + 1


def prefix_column(percent: int = PERCENT):
    return F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1


def early(n, percent: int = PERCENT):
    """The last place at which the smaller set of a linked pair holds the first shingle of both."""
    return n - F.floor((2 * percent * n + 99 + percent) / (100 + percent))


def needed(n, m, percent: int = PERCENT):
    """How many shingles linked sets of n and m shingles share at least."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def _identity(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _name(s: np.ndarray, clashing: frozenset[int]) -> int:
    """A set's identity v: the first word of its digest, the second where several sets have that first word."""
    v, w = _identity(s)
    return w if v in clashing else v


# -- 1. sets and the sketch ------------------------------------------------------------------

_SETS = "doc_id bigint, h bigint, n bigint, v bigint, w bigint, slice int, counts binary"


def _scan(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(1 << BITS, dtype=np.uint32), [], 0

        def count() -> None:
            t = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            times = np.diff(np.append(first, len(t)))
            many = times > 1
            np.add.at(sketch, (t[first[many]] >> np.uint64(64 - BITS)).astype(np.int64), times[many].astype(np.uint32))

        for b in batches:
            n, v, w = [], [], []
            for s in sets(b.column("text").to_pylist(), width):
                n.append(len(s))
                a = _identity(s) if len(s) else (None, None)
                v.append(a[0])
                w.append(a[1])
                held.append(s)
                size += len(s)
                if size > CHUNK:
                    count()
                    held, size = [], 0
            k = len(n)
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["doc_id", "h", "n", "v", "w", "slice", "counts"])
        if size:
            count()
        used = [i for i in range((1 << BITS) // SLICE) if sketch[i * SLICE : (i + 1) * SLICE].any()]
        blobs = [zlib.compress(sketch[i * SLICE : (i + 1) * SLICE].tobytes(), 1) for i in used]
        none = pa.nulls(len(used), pa.int64())
        yield pa.record_batch([none, none, none, none, none, pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "h", "n", "v", "w", "slice", "counts"])

    return common.trimmed(scan)


def _order(scanned: DataFrame) -> np.ndarray:
    """For each cell of the sketch the rank of its count, in doublings: 4 MB at any size of input."""

    def add(own: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, dtype=np.uint64)
        for c in own["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype=np.uint32)
        level = np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
        return pd.DataFrame({"slice": own["slice"].iloc[:1], "level": [level.tobytes()]})

    out = np.zeros(1 << BITS, dtype=np.uint8)
    for r in scanned.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, level binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["level"], dtype=np.uint8)
    return out


# -- 2. the index ----------------------------------------------------------------------------

_ENTRIES = "part int, entries binary, owners binary, lasts binary"


def _index(width: int, percent: int, parts: int, order, clashing: frozenset[int], bits: int = TOKEN):
    """Packed entries by part. Parts from 0 on hold one entry of a shingle each, to meet those of other tasks. Those under 0
    hold entries that have met, and where sets' indexed parts end; they are dealt by set, so a shingle of many
    sets is no hot spot.

    Shingles go by ``bits`` bits of their hash: of two that agree there a set counts both, so lists, and
    what is shared, are too large at most, never too small."""

    def packed(part: np.ndarray, entry: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((owner, part))
        used, cuts = np.unique(part[by], return_index=True)
        cuts = np.append(cuts, len(part)).tolist()
        blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (entry[by], owner[by])]
        return pa.record_batch([pa.array(used.astype(np.int32)), *blobs, pa.nulls(len(used), pa.binary())], names=["part", "entries", "owners", "lasts"])

    def by_set(owner: np.ndarray) -> np.ndarray:
        return -1 - (owner.view(np.uint64) % np.uint64(parts)).astype(np.int64)

    def flush(held: list[tuple], ends: dict[int, int]) -> Iterator[pa.RecordBatch]:
        sets_, last = np.array(list(ends), dtype=np.int64), np.array(list(ends.values()), dtype=np.int32)
        done = packed(by_set(sets_), last, sets_)
        yield pa.record_batch([done.column("part"), done.column("lasts"), done.column("owners"), done.column("entries")], names=done.schema.names)
        token, owner, place = (np.concatenate(x) for x in zip(*held, strict=True))
        token = token >> np.uint64(64 - bits)
        entry = (token << np.uint64(PLACE)) | np.minimum(place, (1 << PLACE) - 1).astype(np.uint64)
        by = np.argsort(token, kind="stable")
        token, owner, entry = token[by], owner[by], entry[by]
        first = np.append(True, token[1:] != token[:-1])
        many = ~first
        many[:-1] |= ~first[1:]
        if many.any():
            yield packed(by_set(owner[many]), entry[many], owner[many])
        yield packed((token[first] % np.uint64(parts)).astype(np.int64), entry[first], owner[first])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, size, ends = order.value, [], 0, {}
        for b in batches:
            for s in sets(b.column("text").to_pylist(), width):
                if not len(s):
                    continue
                v = _name(s, clashing)
                if v in ends:
                    continue
                k = prefix(len(s), percent)
                level = levels[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                rank = np.argsort(level, kind="stable")[:k]
                # Where the indexed part ends in the global order: the level, then as much of the hash as an int holds.
                ends[v] = (int(level[rank[-1]]) << 24) | int(s[rank[-1]] >> np.uint64(40))
                held.append((s[rank], np.full(k, v), np.arange(k, dtype=np.int32)))
                size += k
                if size > CHUNK:
                    yield from flush(held, ends)
                    held, size, ends = [], 0, {}
        if held:
            yield from flush(held, ends)

    return common.trimmed(index)


def _meet(own: pd.DataFrame) -> pd.DataFrame:
    """Entries of a part whose shingle several sets have; of a part that is dealt by set, all. Rows without a token tell where
    a set's indexed part ends, in place."""
    has, ends = own[own["lasts"].isna()], own[own["lasts"].notna()]
    entry, owner = (np.frombuffer(b"".join(has[c]), dtype=t) for c, t in (("entries", np.uint64), ("owners", np.int64)))
    by = np.lexsort((owner, entry))
    entry, owner = entry[by], owner[by]
    new = np.append(True, (entry[1:] != entry[:-1]) | (owner[1:] != owner[:-1]))[: len(entry)]
    entry, owner = entry[new], owner[new]
    if own["part"].iloc[0] >= 0:
        token = entry >> np.uint64(PLACE)
        same = token[1:] == token[:-1]
        many = np.append(False, same) | np.append(same, False)
        entry, owner = entry[many[: len(entry)]], owner[many[: len(owner)]]
    token, place = (entry >> np.uint64(PLACE)).astype(np.int64), (entry & np.uint64((1 << PLACE) - 1)).astype(np.int32)
    met = pd.DataFrame({"token": pd.array(token, dtype="Int64"), "v": owner, "place": place})
    if len(ends):
        v, last = (np.frombuffer(b"".join(ends[c]), dtype=t) for c, t in (("owners", np.int64), ("lasts", np.int32)))
        met = pd.concat([met, pd.DataFrame({"token": pd.array([None] * len(v), dtype="Int64"), "v": v, "place": last})], ignore_index=True)
    del entry, owner, token, place, by, new
    common.trim()
    return met


# -- 3. comparisons --------------------------------------------------------------------------

_ANSWER = "a bigint, b bigint, common bigint, na bigint, nb bigint, less binary, more binary"


def _compare(width: int):
    """Overlaps of pairs of texts' sets. ``less`` and ``more``: what b lacks of a and has beyond it, where they
    share at least half of their union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            want = {}
            for side, text in (("a", "text_a"), ("b", "text_b")):
                ids = b.column(side).to_pylist()
                for i, v in enumerate(ids):
                    if v not in known and v not in want:
                        want[v] = (text, i)
            texts = [b.column(t)[i].as_py() for t, i in want.values()]
            new = dict(zip(want, sets(texts, width), strict=True))
            new.update((x, known[x]) for x in {*a, *c} & known.keys())
            both, na, nb, less, more = [], [], [], [], []
            for x, y in zip(a, c, strict=True):
                s, t = new[x], new[y]
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                same = t[at] == s if len(t) else np.zeros(len(s), dtype=bool)
                n = int(same.sum())
                union = len(s) + len(t) - n
                keep = 2 * n >= union
                other = np.ones(len(t), dtype=bool)
                other[at[same]] = False
                both.append(n)
                na.append(len(s))
                nb.append(len(t))
                less.append(s[~same].tobytes() if keep else None)
                more.append(t[other].tobytes() if keep else None)
            # Rows come sorted by a, so its set serves the next batch too.
            known = {a[-1]: new[a[-1]]} if a else {}
            yield pa.record_batch([b.column("a"), b.column("b"), *(pa.array(x, pa.int64()) for x in (both, na, nb)), pa.array(less, pa.binary()), pa.array(more, pa.binary())], names=["a", "b", "common", "na", "nb", "less", "more"])

    return common.trimmed(compare)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of two sets from their differences from one hub: what both have of it, and what both have beyond it."""
    for b in batches:
        common = []
        for nh, *parts in zip(*(b.column(c).to_pylist() for c in ("nh", "less_a", "more_a", "less_b", "more_b")), strict=True):
            la, ma, lb, mb = (np.frombuffer(x, dtype=np.uint64) for x in parts)
            lacking = len(la) + len(lb) - len(np.intersect1d(la, lb, assume_unique=True))
            common.append(nh - lacking + len(np.intersect1d(ma, mb, assume_unique=True)))
        yield pa.record_batch([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _linked(percent: int):
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def _verify(pairs: DataFrame, texts: DataFrame, lend: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """_ANSWER and linked. ``pairs``: a, b, written out. ``texts``: doc_id, h, text; ``lend``: of
    each set v the doc_id and h of a document that has it. Only texts of these sets are read on. A set
    that many pairs name is a skewed join key, which AQE splits."""
    ids = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    need = common.materialise(lend.join(ids, "v").toDF("v", "lend_id", "lend_h"), "join-lend")
    same = texts.doc_id.eqNullSafe(need.lend_id) & (texts.h == need.lend_h)
    wanted = texts.join(common.broadcast_if(need, need.count(), 60), same).select("v", "text")
    if repeated:
        wanted = wanted.dropDuplicates(["v"])
    wanted = common.materialise(wanted, "join-texts")
    # Texts go to the pairs by a broadcast of the pairs while these are few, so each moves once at most.
    with_b = wanted.select(F.col("v").alias("b"), F.col("text").alias("text_b")).join(common.broadcast_if(pairs, pairs.count(), 40), "b")
    both = with_b.join(wanted.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    done = both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(width), _ANSWER)
    done = common.materialise(done.withColumn("linked", _linked(percent)), "join-compared")
    common.forget(need, wanted)
    return done


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``index`` with component: its class, else the set alone. Few labels go to the index, which stays where it is."""
    if labels is None:
        return index.withColumn("component", F.col("v"))
    few = common.broadcast_if(labels, labels.count(), 40)
    return index.join(few, "v", "left").withColumn("component", F.coalesce("component", "v"))


def _hubs(placed: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """token, hub, hub_central, hub_n, hub_rare, hub_last, hub_place: the most central set of each list that has an early entry and
    sets of several classes. Where no set is labelled a list's sets are all of different classes.

    All that is aggregated are numbers of fixed width, so rows are hashed where they stand, by set, and not sorted
    by shingle before the shuffle. Equal ranks change which set is taken, which is free."""
    rank = F.shiftleft((F.col("central") * (1 << 20)).cast("long"), 42).bitwiseOR(F.col("v").bitwiseAND(F.lit((1 << 42) - 1)))
    sizes = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("rare").cast("long"))
    ends = F.shiftleft(F.col("last").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
    found = [F.max_by(c, "rank").alias(name) for c, name in (("v", "hub"), ("sizes", "hub_sizes"), ("ends", "hub_ends"))]
    found += [F.max("rank").alias("rank"), F.max(F.col("place") <= early(F.col("n"), percent)).alias("starts")]
    if labelled:
        found += [F.min("component").alias("lo"), F.max("component").alias("hi")]
    lists = placed.withColumns({"rank": rank, "sizes": sizes, "ends": ends}).groupBy("token").agg(*found)
    lists = lists.filter("starts AND lo <> hi" if labelled else "starts")
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    return lists.select("token", "hub", F.shiftright("rank", 42).alias("hub_central"), F.shiftright("hub_sizes", 32).alias("hub_n"), low("hub_sizes").alias("hub_rare"), F.shiftright("hub_ends", 32).alias("hub_last"), low("hub_ends").alias("hub_place"))


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (v, component) with the classes that ``links`` join made one: the graph of classes is small."""
    if labels is None:
        return common.materialise(components(links.toDF("u", "v")), "join-labels")
    of = lambda c: F.coalesce(F.col(f"component_{c}"), F.col(c))
    both = links.join(labels.toDF("a", "component_a"), "a", "left").join(labels.toDF("b", "component_b"), "b", "left")
    joined = components(both.select(of("a").alias("u"), of("b").alias("v"))).toDF("component", "root")
    known = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti").withColumn("component", F.col("v")))
    return common.materialise(known.join(joined, "component", "left").select("v", F.coalesce("root", "component").alias("component")), "join-labels")


# -- the join --------------------------------------------------------------------------------

def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(rows, classes of equal sets by their identity v, first words that several sets have). At 5e10
    documents some dozens of sets share their first 64 bits; those go by their second 64 bits."""
    clashing: frozenset[int] = frozenset()
    while True:
        named = rows.withColumn("v", F.when(F.col("v").isin(*clashing), F.col("w")).otherwise(F.col("v"))) if clashing else rows
        classes = common.materialise(
            named.filter("v is not null").groupBy("v").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("n").alias("n"), F.min("w").alias("w"), F.max("w").alias("w2")), "join-classes")
        more = frozenset(r["v"] for r in classes.filter("w <> w2").select("v").collect())
        if not more:
            return named, classes, clashing
        if clashing:
            raise RuntimeError("sets of equal second words among those of equal first words: change the digest")  # not expected in 1e12 documents
        clashing = more


def join_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, h (hash of the text), n_shingles, v (the set's identity, null for an empty set),
    component_id (smallest doc_id of the class). links: pairs of set identities that were compared
    and reach the threshold; with the rows of equal v they span every class.

    Null and empty texts and texts without words have no set and stand alone. Rows of equal id are
    rows of their own. A null id takes part, but never names a class that holds another id.
    """
    with common.batches_of(docs.sparkSession, 250):
        return _join_classes(docs, id_col, text_col, width, percent, rounds)


def _join_classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    scanned = common.materialise(texts.mapInArrow(_scan(width), _SETS), "join-sets")
    rows, classes, clashing = _classes(scanned.filter("slice is null").select("doc_id", "h", "n", "v", "w"))
    entries = classes.agg(F.sum(prefix_column(percent))).first()[0] or 0
    order = spark.sparkContext.broadcast(_order(scanned))
    packed = texts.select("text").mapInArrow(_index(width, percent, max(1, -(-entries // PART)), order, clashing, TOKEN), _ENTRIES)
    # Entries go straight to their parts: written out first, they would lie on disk twice.
    met = common.materialise(packed.groupBy("part").applyInPandas(_meet, "token bigint, v bigint, place int"), "join-met")
    last = met.filter("token is null").groupBy("v").agg(F.min("place").alias("last"))
    # An entry that two tasks pass on comes twice; dealt by set, repeats go and the rest is counted in one place.
    index = met.filter("token is not null").repartition("v").distinct()
    # How central a set is: the share of its indexed shingles that others index. A text has it high, its edited copies low.
    # The others, rare ones, are in no set whose indexed part goes as far in the global order.
    own, first = F.count("*").over(Window.partitionBy("v")), prefix_column(percent)
    index = index.withColumn("own", own).join(classes.select("v", "n").join(last, "v"), "v").withColumns({"central": F.col("own") / first, "rare": F.when(first >= 1 << PLACE, 0).otherwise(first - F.col("own"))}).drop("own")  # late places of huge sets are not told apart
    index = common.materialise(index, "join-index")
    common.forget(met)

    # The document that lends its text to a set: found by id and, as ids may repeat, by the text's hash.
    lend = classes.select("v", "one.doc_id", "one.h")
    repeated = not rows.groupBy("doc_id", "h").agg(F.count("*").alias("times")).filter("times > 1").isEmpty()

    def may(x, y):
        """Whether sizes, rare shingles and the places of a shared one leave room for the threshold. The set whose
        indexed part ends first shares none of its rare ones; equal ends may be equal by rounding only."""
        left_x, left_y = x("n") - x("rare"), y("n") - y("rare")
        most = F.when(x("last") < y("last"), left_x).when(x("last") > y("last"), left_y).otherwise(F.greatest(left_x, left_y))
        least = needed(x("n"), y("n"), percent)
        return (F.least(most, x("n"), y("n")) >= least) & (x("place") <= x("n") - least) & (y("place") <= y("n") - least)

    labels = links = answers = None
    for _ in range(rounds):
        # Of each list with early entries, the most central set.
        placed = _labelled(index, labels)
        hubs = _hubs(placed, percent, labels is not None)
        near = placed.join(hubs, "token").filter(F.col("v") != F.col("hub")).filter(may(F.col, lambda c: F.col(f"hub_{c}")))
        if labels is not None:
            near = near.join(common.broadcast_if(labels, labels.count(), 40).toDF("hub", "hub_component"), "hub", "left").filter(F.col("component") != F.coalesce("hub_component", "hub"))
        shared = near.groupBy("v", "hub").agg(F.count("*").alias("times"), F.max("hub_central").alias("hub_central"))
        if answers is not None:
            done = answers.select(F.col("b").alias("v"), F.col("a").alias("hub")).unionByName(answers.select(F.col("a").alias("v"), F.col("b").alias("hub")))
            shared = shared.join(done, ["v", "hub"], "left_anti")
        best = shared.groupBy("v").agg(F.max_by("hub", F.struct("times", "hub_central", "hub")).alias("hub"))
        pairs = common.materialise(best.select(F.col("hub").alias("a"), F.col("v").alias("b")), "join-pairs")
        new = _verify(pairs, texts, lend, width, percent, repeated)
        answers = new if answers is None else answers.unionByName(new)
        fresh = new.filter("linked").select("a", "b")
        links = fresh if links is None else links.unionByName(fresh)
        if fresh.isEmpty():
            break
        labels = _merge(labels, fresh)

    # Lists with early entries whose sets lie in several classes.
    # Of each its least block with an early entry and its largest block tell which entries can be of a pair.
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    placed = _labelled(index.drop("central"), labels).withColumns({"starts": F.col("place") <= early(F.col("n"), percent), "block": block})
    spread = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.when(F.col("starts"), F.col("block"))).alias("low"), F.max("block").alias("top"))
    spread = spread.filter("lo <> hi AND low IS NOT NULL").select("token", "low", "top")
    far = F.struct((1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far"), F.col("a").alias("hub"), "common", F.col("less").isNotNull().alias("kept"))
    hub_of = answers.groupBy(F.col("b").alias("v")).agg(F.min(far).alias("near")).select("v", "near.*")
    left = common.materialise(placed.join(spread, "token").filter("block >= low").drop("low").join(hub_of, "v", "left"), "join-left")
    names = ("v", "n", "rare", "last", "place", "component", "hub", "far", "common", "kept")
    x = left.filter("starts").select("token", *[F.col(c).alias(c + "_x") for c in names], F.explode(F.when(F.col("block") < F.col("top"), F.array("block", F.col("block") + 1)).otherwise(F.array("block"))).alias("block"))
    y = left.select("token", "block", *[F.col(c).alias(c + "_y") for c in names])
    one_hub = F.coalesce(F.col("hub_x") == F.col("hub_y"), F.lit(False))
    least = needed(F.col("n_x"), F.col("n_y"), percent)
    by_hub = F.least("common_x", "common_y") + F.least(F.col("n_x") - F.col("common_x"), F.col("n_y") - F.col("common_y"))
    apart = F.coalesce(one_hub & ((F.abs(F.col("far_x") - F.col("far_y")) > (100 - percent) / 100 + 1e-9) | (by_hub < least)), F.lit(False))
    found = x.join(y, ["token", "block"]).filter(
        (F.col("component_x") != F.col("component_y")) & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("v_x") < F.col("v_y"))))
        & may(lambda c: F.col(c + "_x"), lambda c: F.col(c + "_y")) & ~apart)
    hub = F.when(one_hub & F.col("kept_x") & F.col("kept_y"), F.col("hub_x"))
    found = found.select(F.col("v_x").alias("a"), F.col("v_y").alias("b"), hub.alias("hub")).distinct()
    done = answers.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    rest = found.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(done, ["lo", "hi"], "left_anti")
    rest = common.materialise(rest.select("a", "b", "hub"), "join-rest")
    common.forget(left)
    if not rest.isEmpty():
        kept = answers.filter("less is not null")
        side = lambda c: kept.select(F.col("b").alias(c), F.col("a").alias("hub"), F.col("nb").alias("n" + c), F.col("less").alias("less_" + c), F.col("more").alias("more_" + c), *([F.col("na").alias("nh")] if c == "a" else []))
        by_answers = rest.filter("hub is not null").join(side("b"), ["b", "hub"]).join(side("a"), ["a", "hub"])
        by_answers = by_answers.mapInArrow(_derive, "a bigint, b bigint, na bigint, nb bigint, common bigint").filter(_linked(percent)).select("a", "b")
        by_texts = _verify(common.materialise(rest.filter("hub is null").select("a", "b"), "join-pairs"), texts, lend, width, percent, repeated).filter("linked").select("a", "b")
        more = common.materialise(by_answers.unionByName(by_texts), "join-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = _merge(labels, more)
    named = _labelled(classes, labels)
    # Written out, so that AQE can split the join of a class that holds many sets.
    names = common.materialise(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "join-names")
    of_set = named.select("v", "component").join(names, "component").select("v", "component_id")
    out = rows.join(of_set, "v", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), "v", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out, links


def op8(spark, sf_dir: str) -> DataFrame:
    return join_classes(common.table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicate texts, the one of smallest id, with the columns of ``docs``
    (doc_id, text); rows without words stay. Of rows of equal id and text any one stays."""
    rows, _ = join_classes(docs)
    gone = rows.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), "h")
    gone = common.materialise(gone.distinct(), "join-gone")
    gone = common.broadcast_if(gone, gone.count(), 60).withColumnRenamed("h", "gone_h")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"])
    return docs.join(gone, same, "left_anti")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
