"""Conversation repair: the cheapest edits that give a conversation the shape (system?)(user assistant)*.

A conversation's rows in order and the four states of that shape (nothing yet, after system, after user, after assistant)
make a graph: a node is (rows done, state), an arc is an edit with a small whole cost. Distances to the goal come from
Dial's algorithm: nodes wait in a ring of as many buckets as the dearest arc costs, and the ring is turned, so nothing is
compared or sorted. Arcs that keep to the distances are tight; walking them from the start and always taking the one with
the least letter gives, of all cheapest edit scripts, the first in ASCII order.

A long conversation is no single task's work until its texts are joined. Rows get their places by a range sort; a block of
``block`` rows becomes a short string of roles and faults. Dial's distances over a block, from each state it may end in, are a
4 x 4 table; a scan over the blocks from the last to the first turns these into each block's distances to the goal; blocks
are then walked from each of the four states, all at once, and a scan from the first block on keeps the walk that the block
before leads to. The scans carry four numbers. Only the script itself, one value by its nature, and the pass that writes
the repaired rows out in order take a conversation as one sorted stream; they hold one row and the script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Costs of the edits; a row without a proper end that stays adds one more.
KEEP, REROLE, DELETE, INSERT, LOOSE_END = 0, 1, 2, 5, 5
RING = 1 + max(INSERT, REROLE + LOOSE_END, DELETE)
FAR = 1 << 40
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a kept row leads to, and what a row that is
#: given its role, or put in, leads to.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Behind the last row: the cost of completing the shape, and how many rows that puts in.
GOAL = (0, 2 * INSERT, INSERT, 0)
PUT_IN = (0, 2, 1, 0)
BLOCK = 1024


def edits(role: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """Arcs that use a row up: (letter, cost, next state), by letter."""
    out = [("D", DELETE, state)]
    if fault not in "bd":
        more = LOOSE_END if fault == "t" else 0
        if role in KEPT[state]:
            out.append(("K", KEEP + more, KEPT[state][role]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def distances(codes: str) -> tuple[tuple[int, ...], ...]:
    """By state at the block's end: distances from each node (place * 4 + state) to that end. ``codes``: two
    letters a row, the role's initial and the fault."""
    return _short(codes) if len(codes) <= 64 else _dial(codes)


def _dial(codes: str) -> tuple[tuple[int, ...], ...]:
    n = len(codes) // 2
    into: list[list[tuple[int, int]]] = [[] for _ in range(4 * n + 4)]
    for i in range(n):
        for s in range(4):
            into[4 * i + NEXT[s]].append((INSERT, 4 * i + s))
            for _, cost, t in edits(codes[2 * i], codes[2 * i + 1], s):
                into[4 * i + 4 + t].append((cost, 4 * i + s))
    found = []
    for end in range(4):
        dist = [FAR] * (4 * n + 4)
        dist[4 * n + end] = 0
        ring: list[list[int]] = [[] for _ in range(RING)]
        ring[0].append(4 * n + end)
        d, waiting = 0, 1
        while waiting:
            bucket = ring[d % RING]
            while bucket:  # arcs of no cost lead into the bucket at hand
                node = bucket.pop()
                waiting -= 1
                if dist[node] == d:
                    for cost, before in into[node]:
                        if d + cost < dist[before]:
                            dist[before] = d + cost
                            ring[(d + cost) % RING].append(before)
                            waiting += 1
            d += 1
        found.append(tuple(dist))
    return tuple(found)


_short = lru_cache(maxsize=4096)(_dial)  # short conversations are much alike


def walks(codes: str, goal: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state at the block's start the script along tight arcs, and the state at its end. ``goal``: the distances from
    the block's end on."""
    n, by_end = len(codes) // 2, distances(codes)
    dist = [min(d[node] + g for d, g in zip(by_end, goal, strict=True)) for node in range(4 * n + 4)]
    out = []
    for start in range(4):
        i, s, script = 0, start, []
        while i < n and dist[4 * i + s] < FAR:
            left = dist[4 * i + s]
            arcs = [(x, cost, i + 1, t) for x, cost, t in edits(codes[2 * i], codes[2 * i + 1], s)] + [("I", INSERT, i, NEXT[s])]
            x, _, i, s = min(a for a in arcs if a[1] + dist[4 * a[2] + a[3]] == left)
            script.append(x)
        out.append(("".join(script), s))
    return tuple(out)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _stream(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make`` turns an iterator of a partition's rows into one of rows of ``schema``."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(make(_rows_of(batches)), fields)

    return rows.mapInArrow(run, schema)


def _tables(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, block, codes in rows:
        n = len(codes) // 2
        yield conv, block, codes, [distances(codes)[end][s] for end in range(4) for s in range(4)]


def _back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the last block to the first: the distances from each block's end on."""
    before, goal = object(), GOAL
    for conv, block, codes, table in rows:
        if conv != before:
            before, goal, last = conv, GOAL, True
        yield conv, block, codes, list(goal), last
        goal = tuple(min(FAR, min(table[4 * end + s] + goal[end] for end in range(4))) for s in range(4))
        last = False


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, block, codes, goal, last in rows:
        found = walks(codes, tuple(goal))
        yield conv, block, codes, [script + "I" * (PUT_IN[end] if last else 0) for script, end in found], [end for _, end in found], min(distances(codes)[e][0] + goal[e] for e in range(4)), last


def _forth(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the first block on: one row for each conversation."""
    script, state, counts, cost, end = [], 0, [0] * 4, 0, ""
    for conv, block, codes, scripts, ends, total, last in rows:
        if block == 0:
            script, state, counts, cost, end = [], 0, [0] * 4, total, ""
        script.append(scripts[state])
        state = ends[state]
        roles = end + codes[::2]
        for k, fault in enumerate("bdt"):
            counts[k] += codes[1::2].count(fault)
        counts[3] += sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False))
        end = roles[-1:]
        if last:
            yield conv, *counts, cost, "".join(script)


AUDIT = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
ROWS = ["conv_id", "turn", "role", "text"]


def _digest() -> Column:
    """Of role and text; the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256))


def _named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null role and text are one space."""
    c, turn, role, text = columns
    return rows.select(F.col(c).cast("string"), F.col(turn).cast("long"), F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))).toDF(*ROWS)


def audits(rows: DataFrame, columns: list[str] = ROWS, *, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of ``rows``: conv_id (as text), gaps, counts of faults, cost, audit.

    Rows stand by turn (nulls first), then role and a digest of role and text; equal rows one after the other. Null
    conv_id is a conversation; an empty table gives no rows."""
    spark = rows.sparkSession
    named = _named(rows, columns)
    text = F.col("text")
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "b").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    narrow = named.select("conv_id", "turn", "role", _digest().alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))
    placed = common.materialise(common.placed(common.materialise(narrow, "repair-rows"), ["conv_id"], ["turn", "role", "digest"], "at"), "repair-places")
    # The first of equal rows is none of the duplicates. Places are unique, so no key of this join is hot.
    first = placed.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select(F.col("conv_id").alias("f_conv"), F.col("at").alias("f_at"))
    marked = placed.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("at") == F.col("f_at")), "left")
    code = F.concat("initial", F.when(F.col("f_at").isNull() & (F.col("fault") != "b"), "d").otherwise(F.col("fault")))
    blocks = marked.groupBy("conv_id", F.expr(f"at div {block}").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", code.alias("code")))), lambda x: x.code), "").alias("codes"))
    spread = common.materialise(_stream(blocks, _tables, "conv_id string, block bigint, codes string, table array<bigint>"), "repair-tables")
    back = spread.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    back = common.materialise(_stream(back, _back, "conv_id string, block bigint, codes string, goal array<bigint>, last boolean"), "repair-goals")
    walked = _stream(back.repartition("conv_id", "block"), _walk, "conv_id string, block bigint, codes string, scripts array<string>, ends array<int>, cost bigint, last boolean")
    walked = common.materialise(walked, "repair-walks").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    found = _stream(walked, _forth, "conv_id string, " + AUDIT)
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    t = turns.withColumnRenamed("conv_id", "t_conv")
    return common.materialise(found.join(t, F.col("conv_id").eqNullSafe(F.col("t_conv"))).drop("t_conv"), "repair-audits")


def _apply(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A conversation's script, then its rows in order: the repaired rows."""
    script, i, state, n = "", 0, 0, 0
    conv = None

    def put_in() -> Iterator[tuple]:
        nonlocal i, state, n
        while i < len(script) and script[i] == "I":
            state = NEXT[state]
            yield conv, n, NAMES[state], "", "I"
            i, n = i + 1, n + 1

    for own, _, given, role, text in rows:
        if given is not None:
            yield from put_in()
            conv, script, i, state, n = own, given, 0, 0, 0
            continue
        yield from put_in()
        x, i = script[i], i + 1
        if x != "D":
            state = NEXT[state] if x == "R" else KEPT[state][role[0]]
            yield conv, n, NAMES[state] if x == "R" else role, text, x
            n += 1
    yield from put_in()


def repaired(rows: DataFrame, found: DataFrame, columns: list[str] = ROWS) -> DataFrame:
    """The rows of the repaired conversations: conv_id (as text), place, role, text, edit (K kept, R given its role, I put in).
    ``found``: the audits of ``rows``. A conversation's rows come together and in order of place."""
    named = _named(rows, columns)
    heads = found.select("conv_id", F.lit(0).alias("tag"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("turn", "long"), ("digest", "binary"))))
    own = named.select("conv_id", F.lit(1).alias("tag"), F.lit(None).cast("string").alias("audit"), "role", "text", "turn", _digest().alias("digest"))
    both = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest")
    return _stream(both.select("conv_id", "tag", "audit", "role", "text"), _apply, "conv_id string, place bigint, role string, text string, edit string")


def _sums(rows: Iterator[tuple]) -> Iterator[tuple]:
    import hashlib

    before, h = None, None
    for conv, _, role, text, _ in rows:
        if h is None or conv != before:
            if h is not None:
                yield before, h.hexdigest()
            before, h = conv, hashlib.sha256()
        else:
            h.update(b"\n")
        h.update(f"{role}:{text}".encode())
    if h is not None:
        yield before, h.hexdigest()


def checksums(repaired_rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines ``role:text``; conversations without rows are not there. Takes ``repaired``'s
    result as it comes, by conversation and in order; a digest is a chain, so that pass reads a conversation in one stream."""
    return _stream(repaired_rows, _sums, "conv_id string, repaired_sha256 string")


def damaged(rows: DataFrame, columns: list[str] = ROWS) -> DataFrame:
    """``rows`` as conv_id, turn, role, text, with faults by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 without
    text, 2 without its ends of sentences, 3 twice, 4 as a user's. Nulls, in the key too, are one space; turn stays."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select(*columns).toDF(*ROWS).withColumn("k", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")
    return x.filter("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies).drop("copy")


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def op12(spark, sf_dir: str) -> DataFrame:
    given = common.table(spark, sf_dir, "conversations")
    rows = damaged(given)
    found = audits(rows)
    sums = checksums(repaired(rows, found)).withColumnRenamed("conv_id", "s_conv")
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    all_ = ids.join(found, F.col("id").cast("string").eqNullSafe(F.col("conv_id")), "left").join(sums, F.col("id").cast("string").eqNullSafe(F.col("s_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


# The cheapest script by a table of states, row after row: of equal cost the least letters so far, as scripts of the same rows
# never begin one another. Each entry carries its lines.
OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {common.CRC_TABLE_SQL} AS crc_table),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {common.crc_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, crc),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE k <> 0),
o AS (SELECT *, sha256(concat(strlen(role), ':', role, ':', text)) AS digest FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM o),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM p),
put(s, t, n, lines) AS (VALUES (0, 0, 0, []::VARCHAR[]), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (2, 2, 0, []), (2, 3, 1, ['assistant:']), (3, 3, 0, []), (3, 2, 1, ['user:'])),
arc(t, x, initial, next, cost) AS (VALUES (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1)),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM f
  UNION ALL
  SELECT f.conv_id, f.i, arc.next, min({{'cost': w.best.cost + 5 * put.n + arc.cost + CASE WHEN arc.x <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END, 'audit': w.best.audit || repeat('I', put.n) || arc.x,
    'lines': w.best.lines || put.lines || CASE arc.x WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE arc.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END}})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN put ON put.s = w.s JOIN arc ON arc.t = put.t AND (arc.x = 'D' OR f.fault NOT IN ('b', 'd')) AND (arc.initial IS NULL OR arc.initial = f.initial)
  GROUP BY f.conv_id, f.i, arc.next),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  (SELECT count(*) FROM (SELECT concat(lag(initial) OVER (ORDER BY i), initial) AS two, i FROM f y WHERE y.conv_id IS NOT DISTINCT FROM f.conv_id) WHERE i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT w.conv_id, min({{'cost': w.best.cost + 5 * z.n, 'audit': w.best.audit || repeat('I', z.n), 'lines': w.best.lines || z.lines}}) AS best FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n
  JOIN (VALUES (0, 0, []::VARCHAR[]), (1, 2, ['user:', 'assistant:']), (2, 1, ['assistant:']), (3, 0, [])) z(s, n, lines) ON z.s = w.s GROUP BY w.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""
