"""Divergence audit, conversation repair, rendezvous sharding: odd input, and each against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from lumenscan.llm import divergence, html_main, langid, repair, sharding

DOCS = "doc_id long, text string, lang string, source string"
TALK = "conv_id long, turn long, role string, text string"


# -- divergence ----------------------------------------------------------------------------

def brute_audit(rows, a):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, groups = Counter(), defaultdict(Counter)
    for _, text, lang, source in rows:
        groups[lang or "", source or ""].update(words(text))
        docs.update({(lang or "", t) for t in words(text)})
    out = set()
    for lang in {k[0] for k in groups}:
        kept = sorted((t for (x, t), n in docs.items() if x == lang and n >= a.min_docs), key=str.encode)
        own = {s: [c[t] for t in kept] for (x, s), c in groups.items() if x == lang}
        p = {s: [1 + a.unit * (n + a.smooth) // (sum(c) + a.smooth * len(kept)) for n in c] for s, c in own.items()}
        total = [sum(c[k] for c in own.values()) for k in range(len(kept))]
        q = [1 + a.unit * (n + a.smooth) // (sum(total) + a.smooth * len(kept)) for n in total]
        for s in own:
            part = [("pair", o, sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True))) for o in own if o != s]
            part += [("term", t, p[s][k] - q[k]) for k, t in enumerate(kept) if own[s][k] and p[s][k] > q[k]]
            for kind in ("pair", "term"):
                ranked = sorted(((i, v) for x, i, v in part if x == kind), key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, kind, i, v, k) for k, (i, v) in enumerate(ranked, 1) if kind == "pair" or k <= a.top}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(260):  # a source with a third of all rows, sources of very different sizes, shared and own words
        source = rng.choice(["hot", "hot", "b", "c", "D", "é", None, "tiny" if i % 20 == 0 else "b"])
        text = " ".join(rng.choice([f"w{rng.choice('abcdefgh')}", f"{source}x", "The", "the", "Éa", "éa", "中文", "a1b", "z" * rng.randrange(1, 4)]) for _ in range(rng.randrange(30)))
        rows.append((i, rng.choice([text, text, text, "", None]), rng.choice(["en", "en", "fr", None]), source))
    rows += [(900, "rare words only", "de", "x"), (901, None, "de", "y"), (902, "", "it", "alone"), (None, None, None, None), (5, "the the", "en", "hot"), (5, "the the", "en", "hot")]
    a = divergence.Audit(min_docs=6, top=3, max_held=50)
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("n"), F.lit(2).alias("term"), F.lit(3).alias("gid"))
    got = [tuple(r) for r in divergence.audit(docs, a).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, a)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact(spark):
    """Counts beyond the range of long products."""
    a = divergence.Audit()
    n, size, v = 7 * 10**13 + 1, 9 * 10**14, 12_345
    got = spark.createDataFrame([(n, size, v)], "n long, size long, v long").select(divergence.share(F.col("n"), F.col("size"), F.col("v"), a)).first()[0]
    assert got == 1 + a.unit * (n + 5) // (size + 5 * v)


# -- conversations -------------------------------------------------------------------------

SHAPE = {"": 0, "s": 1, "u": 2, "a": 3}
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_damage(rows):
    space = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """Plain shortest paths over (cost, script) with a heap."""
    rows = sorted(rows, key=lambda r: ((0, 0) if r[1] is None else (1, r[1]), r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, script, i, s, lines = heappop(heap)
        if i == len(rows) and s in (0, 3):
            break
        if (i, s) in done:
            continue
        done.add((i, s))
        for role in ("user", "assistant"):
            if (s, role[0]) in AFTER:
                heappush(heap, (cost + 5, script + "I", i, AFTER[s, role[0]], (*lines, role + ":")))
        if i < len(rows):
            heappush(heap, (cost + 2, script + "D", i + 1, s, lines))
            more = 5 if faults[i] == "truncated" else 0
            if faults[i] in ("", "truncated"):
                if (s, rows[i][2][:1]) in AFTER:
                    heappush(heap, (cost + more, script + "K", i + 1, AFTER[s, rows[i][2][0]], (*lines, f"{rows[i][2]}:{rows[i][3]}")))
                for role in ("user", "assistant"):
                    if (s, role[0]) in AFTER:
                        heappush(heap, (cost + more + 1, script + "R", i + 1, AFTER[s, role[0]], (*lines, f"{role}:{rows[i][3]}")))
    turns = {r[1] for r in rows} - {None}
    first = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, script, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def talk(rng, conv, n):
    rows = []
    for t in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
        text = rng.choice(["Yes.", "No!\n", "what now", "", " \t", "é?", "Yes.", None, "a.b", f"Own {rng.random()}."])
        rows.append((conv, rng.choice([t, t, t, t + rng.randrange(3), None]), "system" if t == 0 and rng.random() < 0.4 else rng.choice([role, role, role, role, None, "tool", "", "User"]), text))
    return rows


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(3), []
    for conv in range(70):
        rows += talk(rng, conv, rng.randrange(1, 9))
    rows += talk(rng, None, 6) + talk(rng, 500, 90) + [(501, 0, "user", "Same."), (501, 0, "user", "Same.")] * 3 + [(502, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_repair_against_brute_force(spark, talks, block):
    rows = spark.createDataFrame(talks, TALK).select("text", F.lit(1).alias("at"), "role", F.lit("x").alias("codes"), "turn", "conv_id")
    hurt = repair.damaged(rows)
    found = repair.audits(hurt, block=block)
    sums = {r[0]: r[1] for r in repair.checksums(repair.repaired(hurt, found)).collect()}
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums.get(r["conv_id"], repair.EMPTY)) for r in found.collect()}
    by = defaultdict(list)
    for r in brute_damage(talks):
        by[None if r[0] is None else str(r[0])].append(r)
    assert got == {k: brute_repair(v) for k, v in by.items()}


def test_repaired_rows_have_the_shape(spark, talks):
    rows = spark.createDataFrame(talks, TALK)  # undamaged, for which the operator is made
    out = defaultdict(list)
    for r in repair.repaired(rows, repair.audits(rows)).collect():
        out[r["conv_id"]].append(r)
    for own in out.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in own))


def test_every_conversation_comes_back(spark, talks, tmp_path):
    gone = next(t for t in range(1000) if zlib.crc32(f"900:{t}".encode()) % 20 == 0)
    rows = [*talks, (900, gone, "user", "All of it is dropped.")]
    spark.createDataFrame(rows, TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in repair.op12(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and (got[900]["audit"], got[900]["cost"], got[900]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    spark.createDataFrame([], TALK).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert repair.op12(spark, str(tmp_path / "none")).count() == 0


def test_equal_costs_take_the_least_letters():
    # An assistant's row alone: D costs 2, a user's row put before it 5, its role changed and an answer put in 6.
    assert repair.walks("a-", repair.GOAL)[0] == ("D", 0)
    # A complete pair whose answer was given to the user: R (1) beats D.
    assert repair.walks("u-u-", repair.GOAL)[0][0] == "KR"
    assert repair.walks("u-a-", repair.GOAL)[0][0] == "KK"


# -- shards --------------------------------------------------------------------------------

def test_slots_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["", None, "text é", "x" * 5000, f"t{i}"])) for i in range(700)] + [(7, "again")] * 300 + [(None, "no id"), (None, None)]
    layout = sharding.Layout.equal(9)
    got = sharding.slots(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")), layout, layout.grown()).collect()
    number = lambda d, k: (int(hashlib.md5(f"{'' if d is None else d}:{k}".encode()).hexdigest()[:13], 16), -k)
    best = lambda d, n: max(range(n), key=lambda k: number(d, k))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), best(d, 9), best(d, 10)) for d, t in rows)
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], 9) for r in got) and any(r["grown_shard"] == 9 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in own]
        assert order == sorted(order)


def test_weights_and_moves(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    layout = sharding.Layout((1.0, 3.0, 2.0), salt="a")
    n = {r[0]: r[1] for r in sharding.assign(docs, layout).groupBy("shard").count().collect()}
    assert all(abs(n[k] / 20_000 - w / 6) < 0.02 for k, w in enumerate(layout.weights))
    gone = sharding.moved(docs, layout, layout.grown(2.0)).collect()
    assert {r["to_shard"] for r in gone} == {3} and abs(len(gone) / 20_000 - 0.25) < 0.02
    heavier = sharding.Layout((1.0, 4.0, 2.0), salt="a")
    assert {r["to_shard"] for r in sharding.moved(docs, layout, heavier).collect()} == {1}
    with pytest.raises(ValueError):
        sharding.Layout(())
    assert sharding.slots(spark.createDataFrame([], DOCS), layout).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s") for i in range(500)]
    layout = sharding.Layout.equal(4)
    sharding.write(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), layout, files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "lang", "source").collect()) == rows
    assert back.filter(F.col("shard") != sharding.shard_of(F.col("doc_id"), layout)).count() == 0


# -- main text -----------------------------------------------------------------------------

def test_article_prose_that_recurs_stays(spark):
    """Sentences that articles of several hosts hold, and one that a few articles of one large host hold; a notice on most
    pages of one host goes, inside the article too, as do menus outside it."""
    rng, rows, want = random.Random(12), [], []
    shared = [f"A closing sentence {k} that many articles share." for k in range(4)]
    for k in range(240):
        site = k % 3
        own = " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
        more = [rng.choice(shared)] if rng.random() < 0.4 else []
        few = ["Only some articles of this host say this."] if site == 0 and k % 36 == 0 else []
        notice = "<p>Read the terms of host one.</p>" if site == 1 and k % 4 else ""
        body = "".join(f"<p>{x}</p>" for x in [own, *few, *more])
        rows.append((k, f"http://host{site}.example.com/{k}", f"<div><b>Menu</b></div><article><h1>Head {k}</h1>{notice}{body}</article><div><i>Imprint</i></div>"))
        want.append(" ".join([f"Head {k}", own, *few, *more]))
    got = {r.page_id: r.main_text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(240)] == want


def test_unclosed_elements_are_read_on():
    for tag in ("object data=x", "select", "iframe src=y", "textarea", "noscript", "svg"):
        assert html_main.main_text(f"<article><p>a</p><{tag}><p>b</p></article>") == "a b", tag
    assert html_main.main_text("<article><p>a</p><object>no</object><p>b</p><object><p>c</p></article>") == "a b c"
    assert html_main.main_text("<p>a</p><script>x = '<p>no</p>'") == "a"


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 700_000, "<p>x</p>" + "<a <b " * 300_000, "<object>" * 200_000, "<p" * 500_000 + ">"):
        began = time.perf_counter()
        html_main.main_text(page)
        assert time.perf_counter() - began < 10, page[:20]


# -- languages -----------------------------------------------------------------------------

def test_three_hundred_languages(spark):
    """All are learnt, in families by likeness, with far fewer pairs than languages have."""
    rng = random.Random(21)
    kin = [[f"{rng.choice('bcdfghklmnprstvz')}{rng.choice('aeiou')}{rng.choice('lnrs')}" for _ in range(10)] for _ in range(20)]
    sound = {f"q{k:03d}": kin[k % 20] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join("".join(rng.choice(sound[x]) for _ in range(2)) for _ in range(40)), x, None) for i, x in enumerate(list(sound) * 14)]
    d = spark.createDataFrame(rows, DOCS)
    model = langid.fit(d.filter("doc_id < 3600"))
    assert sorted(x for own in model.families.values() for x in own) == sorted(sound) and len(model.pairs) < 4500 < 300 * 299 // 2
    out = langid.predict(d.filter("doc_id >= 3600"), model).collect()
    assert len(out) == 600 and sum(r.lang == r.lang_pred for r in out) > 0.9 * len(out)
